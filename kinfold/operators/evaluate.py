"""Precision, recall and F1 of identities against known accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.operators.persons import with_key


def score_pairs(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(truth_id, found_id, common, truth_size, found_size, precision, recall, f1) of every pair that shares an entity.

    ``truth``: (truth_id, entity); ``found``: (found_id, entity). Repeated rows
    count once, rows with a null leave.
    """
    t, p = truth.select("truth_id", "entity").dropna().distinct(), found.select("found_id", "entity").dropna().distinct()
    common = t.join(p, "entity").groupBy("truth_id", "found_id").agg(F.count(F.lit(1)).alias("common"))
    sized = common.join(t.groupBy("truth_id").agg(F.count(F.lit(1)).alias("truth_size")), "truth_id").join(
        p.groupBy("found_id").agg(F.count(F.lit(1)).alias("found_size")), "found_id"
    )
    precision, recall = F.col("common") / F.col("found_size"), F.col("common") / F.col("truth_size")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sized.select("truth_id", "found_id", "common", "truth_size", "found_size", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def identity_scores(people: DataFrame, labels: DataFrame, accounts: DataFrame) -> DataFrame:
    """The scores of whole identities: names, with their scope, and addresses count as entities on both sides.

    ``people``: persons of a run; ``labels``: (id, component); ``accounts``:
    (email, user). An account has the addresses known for it that persons write
    from, and the names written from them.
    """
    rows = with_key(people).select("id", "email", F.explode(F.array(F.concat(F.lit("address "), "email"), F.concat(F.lit("name "), "name_key"))).alias("entity"))
    truth = rows.join(accounts, "email").select(F.col("user").alias("truth_id"), "entity")
    return score_pairs(truth, rows.join(labels, "id").select(F.col("component").alias("found_id"), "entity"))


def macro(scores: DataFrame) -> DataFrame:
    """The plain averages of precision, recall and F1; null without pairs."""
    return scores.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def weighted(scores: DataFrame) -> DataFrame:
    """The averages weighted by the size of what was found; null without pairs."""
    total = F.sum("found_size")
    return scores.agg(*[(F.sum(F.col(c) * F.col("found_size")) / total).alias(c) for c in ("precision", "recall", "f1")])
