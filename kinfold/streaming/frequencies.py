"""Extension: windowed counts of names or addresses over a stream of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinfold.functions.clean import clean

COMMITS = T.StructType([
    T.StructField("row_ix", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("repository_id", "commit_author_name", "commit_author_email", "commit_hash")],
    T.StructField("commit_author_when", T.TimestampType()), T.StructField("loaded_at", T.TimestampType()),
])


def commit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The Parquet files of a folder as they arrive."""
    return spark.readStream.schema(COMMITS).parquet(folder)


def windowed_counts(commits: DataFrame, column: str, window: str = "30 days", late: str = "7 days", when: str = "loaded_at") -> DataFrame:
    """(window_start, value, n): rows of each cleaned value by time of loading; rows later than ``late`` behind are dropped.

    Rows with a null value or time are skipped. Works on a batch frame too.
    """
    rows = commits.where(F.col(column).isNotNull() & F.col(when).isNotNull()).select(F.col(when).alias("t"), clean(F.col(column)).alias("value"))
    if rows.isStreaming:
        rows = rows.withWatermark("t", late)
    return rows.groupBy(F.window("t", window).alias("w"), "value").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "value", "n")
