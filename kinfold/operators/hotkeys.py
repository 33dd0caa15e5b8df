"""Per-key results when a handful of keys hold most rows.

Only native algebraic aggregates are used: every map task folds its rows into
one state per key in the bounded hash table of Spark's partial aggregation
(which spills), so a key holding a third of the table reaches a reducer as one
small row per map task, not as its rows. The number of different repositories
of a key is made algebraic by a first aggregation on (key, repository), whose
groups spread a hot key over all reducers, and a second one on the key alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F


def unpivot_keys(df: DataFrame, fields: Sequence[str], keep: Sequence[Column]) -> DataFrame:
    """One row (``field``, ``key``, *keep*) for each row and field; one scan serves all fields."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("key")) for f in fields])).alias("p")
    return df.select(*keep, pairs).select("p.field", "p.key", *[c for c in df.select(*keep).columns])


def key_statistics(
    df: DataFrame,
    fields: Sequence[str] = ("commit_author_name", "commit_author_email"),
    repository: str = "repository_id",
    when: str = "commit_author_when",
) -> DataFrame:
    """Counts, repositories, first and last time of every value of every field.

    Result: ``field``, ``key``, ``n_rows``, ``n_repositories``, ``first_when``,
    ``last_when``. A null key takes no part; the empty string is a key of its
    own. Null repositories are not counted; null times are skipped, and a key
    without any time has null first and last. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    keep = [F.col(repository).alias("__repo"), F.col(when).alias("__when")]
    rows = unpivot_keys(df, fields, keep).where(F.col("key").isNotNull())
    per_repo = rows.groupBy("field", "key", "__repo").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__when").alias("__first"), F.max("__when").alias("__last")
    )
    return per_repo.groupBy("field", "key").agg(
        F.sum("__n").alias("n_rows"),
        F.count("__repo").alias("n_repositories"),
        F.min("__first").alias("first_when"),
        F.max("__last").alias("last_when"),
    )


def hot_keys(df: DataFrame, share: float = 0.01, fields: Sequence[str] = ("commit_author_name", "commit_author_email")) -> DataFrame:
    """(``field``, ``key``, ``n_rows``) of the keys that hold at least ``share`` of all rows of ``df`` (null keys counted as rows).

    Only the keys are read, and a count is all that is shuffled of each.
    """
    least = math.ceil(Fraction(str(share)) * df.count())  # exact: 0.01 * 700 is above 7 in floating point
    rows = unpivot_keys(df, fields, []).where(F.col("key").isNotNull())
    return rows.groupBy("field", "key").agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= F.lit(least))
