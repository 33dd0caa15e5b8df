"""The queries of this subpackage by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.llm import bpe, groups, leaks, lookalike, spans, spellings, survivors, terms
from kinfold.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each people row in a group of at least two, with the smallest id of the group."""
    return groups.person_groups(table(spark, d, "people"), table(spark, d, "person_links"), table(spark, d, "filter_lists"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Each external account with several rows and the rows whose name and address survive."""
    return p7_records(spark, d).select("external_id_provider", "external_id", "name_id", "email_id")


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each external account with several rows."""
    return survivors.account_survivors(table(spark, d, "people"), table(spark, d, "record_origins"))


NAME_TERMS = {"commit_author_name": terms.words, "commit_author_email": terms.whole}


def _nobodys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "filter_lists").where(F.col("list_name").isin("names", "popular_names")).select(F.lower("entry").alias("entry"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stored author names that are spellings of the same person or organisation."""
    return spellings.spelling_pairs(table(spark, d, "commits"), "commit_author_name", "commit_author_email", _nobodys(spark, d))


def p2_entities(spark: SparkSession, d: str) -> DataFrame:
    """Every stored author name with several spellings, its one form and its entity."""
    return spellings.spelling_entities(table(spark, d, "commits"), "commit_author_name", "commit_author_email", _nobodys(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stored author names that show the same text."""
    return lookalike.same_look_pairs(table(spark, d, "commits"), "commit_author_name")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every stored author name and its one form."""
    return lookalike.canonical_values(table(spark, d, "commits"), "commit_author_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The terms too rare or too common to tell authors apart."""
    return p5_terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences, rows and mark of every term."""
    return terms.marked_terms(table(spark, d, "commits"), NAME_TERMS)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return bpe.encode_column(table(spark, d, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that repeat at least half of an item's words, with the item."""
    return p9_shares(spark, d).select("doc_id", "item_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The leaked items of each document and the part of the item's words it repeats."""
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The runs of characters that also stand in another document, in stretches of at least 200."""
    return spans.shared_spans(table(spark, d, "documents"), "doc_id", "text")


def p10_coverage(spark: SparkSession, d: str) -> DataFrame:
    """For every document its number of runs, shared characters and length; a null text has length 0."""
    sizes = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    runs = p10_found(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("n_shared"))
    return sizes.join(runs, "doc_id", "left").fillna(0, ["n_runs", "n_shared"])


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_entities": p2_entities,
    "p3_found": p3_found, "p3_forms": p3_forms, "p5_found": p5_found, "p5_terms": p5_terms,
    "p7_found": p7_found, "p7_records": p7_records, "p8_ids": p8_ids,
    "p9_found": p9_found, "p9_shares": p9_shares, "p10_found": p10_found, "p10_coverage": p10_coverage,
}
