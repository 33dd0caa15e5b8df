"""Joins in which a few keys hold much of one side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.session import written

#: A key with more than this part of all rows is hot, so there are fewer hot keys than this.
HOT_PARTS = 1000
#: No key with fewer rows is worth a second way.
HOT_ROWS = 200_000


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str | list[str], how: str = "inner", hot_parts: int = HOT_PARTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``lookup``, which has at most one row a key; ``how`` is inner or left.

    Rows of hot keys stay where they are and meet a broadcast of those keys'
    lookups, fewer than ``hot_parts`` rows by construction; all others shuffle.
    ``rows`` is read up to three times, so it should be a written table.
    Null keys match nothing.
    """
    keys = [key] if isinstance(key, str) else key
    n = rows.count()
    least = max(n // hot_parts, hot_rows)
    if n <= least:  # no key can be hot
        return rows.join(lookup, keys, how)
    hot = written(rows.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > least).select(*keys), "hot keys")
    if hot.isEmpty():
        return rows.join(lookup, keys, how)
    known = written(lookup.join(F.broadcast(hot), keys, "left_semi"), "hot lookups")
    there = rows.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), keys, "left")
    many = there.where("__hot").drop("__hot").join(F.broadcast(known), keys, how)
    few = there.where("__hot IS NULL").drop("__hot").join(lookup, keys, how)
    return many.unionByName(few)
