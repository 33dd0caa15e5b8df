"""Links between persons as stars around the first person of a key: one edge a row, never all pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kinfold.functions.lists import FilterLists
from kinfold.operators.persons import with_key

SALTS = 16


def star_edges(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(src, dst): every id of a key and the smallest of its salted part, and the parts' smallest and the key's.

    Two levels, so that a key holding a third of all rows is spread over tasks.
    """
    parts = rows.select(*keys, F.col(id_col).alias("src"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).alias("__salt"))
    inner = parts.withColumn("dst", F.min("src").over(W.partitionBy(*keys, "__salt")))
    tops = parts.groupBy(*keys, "__salt").agg(F.min("src").alias("src"))
    outer = tops.withColumn("dst", F.min("src").over(W.partitionBy(*keys)))
    return inner.select("src", "dst").union(outer.select("src", "dst")).where("src <> dst")


def anchors(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(keys, anchor): the first person of each key."""
    return rows.groupBy(*keys).agg(F.min(id_col).alias("anchor"))


def first_of_key(rows: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """(id, anchor) for every person that is not the first of its key: the edges as the definition has them."""
    return rows.join(anchors(rows, keys, id_col), keys).where(F.col(id_col) != F.col("anchor")).select(F.col(id_col).alias("id"), "anchor").distinct()


def email_rows(people: DataFrame, lists: FilterLists, unmatched: DataFrame | None = None) -> DataFrame:
    """(id, email) that may link: not popular and, with an external source, not resolved by it."""
    rows = people.where(~lists.is_popular_email(F.col("email"))).select("id", "email")
    return rows.join(unmatched.select("email").distinct(), "email", "left_semi") if unmatched is not None else rows


def name_rows(people: DataFrame, lists: FilterLists) -> DataFrame:
    """(id, name_key) that may link: a popular name only within its repository."""
    return with_key(people).where(~lists.is_popular_name(F.col("name_key"))).select("id", "name_key")


def stars(*kinds: tuple[DataFrame, str]) -> DataFrame:
    """(src, dst) star edges of several (rows, key column), all of them in the same shuffles."""
    rows = [df.select("id", F.lit(n).alias("kind"), F.col(key).alias("key")) for n, (df, key) in enumerate(kinds)]
    return star_edges(reduce(DataFrame.unionByName, rows), ["kind", "key"])


def bridges(people: DataFrame, lists: FilterLists) -> DataFrame:
    """(name_key, src, dst): names seen with exactly one external id and also without one link the two firsts.

    With three or more kinds of id the name is ambiguous and links nothing.
    """
    rows = name_rows(people, lists).join(people.select("id", "external_id"), "id")
    firsts = rows.groupBy("name_key", "external_id").agg(F.min("id").alias("anchor"))
    kinds = firsts.groupBy("name_key").agg(
        F.count(F.lit(1)).alias("n"), F.min("anchor").alias("src"), F.max("anchor").alias("dst"), F.max(F.col("external_id") == "").alias("blank")
    )
    return kinds.where("n = 2 AND blank").select("name_key", "src", "dst")


def propagate_ids(labelled: DataFrame, conflict: str = "conflict") -> DataFrame:
    """(component, external_id, conflict): the one id of each component, '' if it has none; ``conflict`` if it has several."""
    known: Column = F.when(F.col("external_id") != "", F.col("external_id"))
    return labelled.groupBy("component").agg(F.coalesce(F.max(known), F.lit("")).alias("external_id"), (F.min(known) != F.max(known)).alias(conflict)).fillna(False, [conflict])
