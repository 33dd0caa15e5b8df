"""Popular values learned from how many different partners they occur with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

COMPARISONS: dict[str, Callable[[Column, int], Column]] = {
    ">": lambda c, n: c > n, ">=": lambda c, n: c >= n, "<": lambda c, n: c < n, "<=": lambda c, n: c <= n, "==": lambda c, n: c == n,
}


def cooccurring(
    rows: DataFrame, key: str, value: str, threshold: int, comparison: str = ">=",
    ignored_key: Callable[[Column], Column] | None = None, ignored_value: Callable[[Column], Column] | None = None,
    prepare_key: Callable[[Column], Column] | None = None, prepare_value: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(key, n_values): keys whose number of different values compares to the threshold, after preparing and ignoring.

    The count of distinct values is made in two steps, so a key seen with very
    many values is spread over tasks first.
    """
    k, v = F.col(key), F.col(value)
    k, v = prepare_key(k) if prepare_key else k, prepare_value(v) if prepare_value else v
    pairs = rows.select(k.alias("key"), v.alias("value")).dropna()
    if ignored_key:
        pairs = pairs.where(~ignored_key(F.col("key")))
    if ignored_value:
        pairs = pairs.where(~ignored_value(F.col("value")))
    counts = pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_values"))
    return counts.where(COMPARISONS[comparison](F.col("n_values"), threshold))
