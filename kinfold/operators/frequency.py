"""How often values occur among signatures, in all and recently, and the primary value of an identity."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window as W, functions as F


def frequencies(signatures: DataFrame, column: str, cutoff: datetime) -> DataFrame:
    """(value, recent, total): signatures by cleaned value, filtered-out ones included; recent is strictly after the cutoff."""
    recent = F.count_if(F.col("ts") > F.lit(cutoff))
    return signatures.groupBy(F.col(column).alias("value")).agg(recent.alias("recent"), F.count(F.lit(1)).alias("total"))


def all_frequencies(signatures: DataFrame, columns: list[str], cutoff: datetime) -> DataFrame:
    """(kind, value, recent, total): the same for several columns in one pass; ``kind`` is the column's name."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in columns])).alias("p")
    recent = F.count_if(F.col("ts") > F.lit(cutoff))
    return signatures.select("ts", pairs).groupBy("p.kind", "p.value").agg(recent.alias("recent"), F.count(F.lit(1)).alias("total"))


def primary_values(values: DataFrame, stats: DataFrame, min_count: int = 5, kinds: list[str] = [], carry: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, value) chosen for each id among its (id, value, key) rows.

    ``kinds``: columns of both tables by which an id has several values;
    ``carry``: columns of which the largest of an id comes along.

    With at least ``min_count`` recent occurrences over all its rows the most
    recent one wins, else the most frequent; ties go to the first by ``key``.
    A name under several scopes counts once for each. Where nothing occurs in
    the deciding count (``min_count`` 0, nothing recent) the value is ''.
    """
    rows = values.join(stats, [*kinds, "value"])
    by_id = W.partitionBy("id", *kinds)
    use_recent = F.sum("recent").over(by_id) >= min_count
    counted = rows.withColumns({"__n": F.when(use_recent, F.col("recent")).otherwise(F.col("total")), **{c: F.max(c).over(by_id) for c in carry}})
    best = counted.withColumn("__rank", F.row_number().over(by_id.orderBy(F.desc("__n"), "key", "value"))).where("__rank = 1")
    return best.select("id", *kinds, F.when(F.col("__n") > 0, F.col("value")).otherwise("").alias("value"), *carry)
