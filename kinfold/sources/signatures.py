"""Signature sources: the source aggregate over a commits table, JDBC, a CSV cache, a research export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from kinfold.functions.clean import clean

#: repo, name, email as stored; hash and time of the group; row_ix: place of the group's first row, which orders the ids.
SCHEMA = T.StructType([
    T.StructField("repo", T.StringType()), T.StructField("name", T.StringType()), T.StructField("email", T.StringType()),
    T.StructField("hash", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("row_ix", T.LongType()),
])
CSV_COLUMNS = ("repo", "name", "email", "hash", "time")
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
DISCOVERY_SQL = (
    "SELECT repository_id, commit_author_name, commit_author_email, MAX(commit_hash) AS hash, MAX(commit_author_when) AS ts "
    "FROM commits GROUP BY repository_id, commit_author_name, commit_author_email"
)


def group_commits(commits: DataFrame) -> DataFrame:
    """One row for each (repository, name, address): the largest hash and, on its own, the latest time.

    Values are as stored, null as the empty string. Without a ``row_ix`` column
    groups are ordered by their key.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    keys = [blank("repository_id").alias("repo"), blank("commit_author_name").alias("name"), blank("commit_author_email").alias("email")]
    states = [F.coalesce(F.max("commit_hash"), F.lit("")).alias("hash"), F.max("commit_author_when").alias("ts")]
    if "row_ix" in commits.columns:
        return commits.groupBy(*keys).agg(*states, F.min("row_ix").alias("row_ix"))
    return with_order(commits.groupBy(*keys).agg(*states))


def with_order(signatures: DataFrame) -> DataFrame:
    """``row_ix`` by (repo, name, email) for a source without an order of its own."""
    from kinfold.operators.persons import dense_numbers

    return dense_numbers(signatures, ["repo", "name", "email"], "row_ix")


def repository_ranges(bounds: Sequence[str]) -> list[str]:
    """Conditions that cut the repositories at ``bounds``, sorted; every row meets just one of them."""
    quoted = ["'" + b.replace("'", "''") + "'" for b in bounds]
    if not quoted:
        return ["1 = 1"]
    inner = [f"repository_id >= {a} AND repository_id < {b}" for a, b in zip(quoted, quoted[1:])]
    return [f"repository_id < {quoted[0]} OR repository_id IS NULL", *inner, f"repository_id >= {quoted[-1]}"]


def from_jdbc(spark: SparkSession, url: str, properties: dict[str, str] | None = None, bounds: Sequence[str] = ()) -> DataFrame:
    """The source aggregate, run by the database; null as the empty string.

    ``bounds``: repositories at which the table is cut into parts that are
    aggregated and read side by side; groups never cross them.
    """
    df = spark.read.jdbc(url, f"({DISCOVERY_SQL}) signatures", predicates=repository_ranges(sorted(bounds)), properties=properties or {})
    return with_order(df.toDF("repo", "name", "email", "hash", "ts").fillna("", ["repo", "name", "email", "hash"]))


def cleaned(signatures: DataFrame) -> DataFrame:
    """Name and address cleaned; rows with a blank repository, name, address or hash, or without a time, leave.

    The same rule holds for every source, so a run from the cache gives what the run that wrote it gave.
    """
    once = F.explode(F.array(F.struct(clean(F.col("name")).alias("name"), clean(F.col("email")).alias("email"))))
    # generated, not projected: the many predicates over the two would each be given a copy of the long expression
    df = signatures.select("repo", "hash", "ts", "row_ix", once.alias("c")).select("repo", "c.name", "c.email", "hash", "ts", "row_ix")
    return df.where("repo <> '' AND name <> '' AND email <> '' AND hash <> '' AND ts IS NOT NULL")


def write_cache(signatures: DataFrame, path: str) -> None:
    """The raw values as CSV with a header, times in RFC 3339, in order of ``row_ix``."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time")
    rows = signatures.orderBy("row_ix").select("repo", "name", "email", "hash", time)
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Signatures from CSV with a header of exactly the five columns, in any order.

    All texts are cleaned; rows with a blank field or a time that is no
    RFC 3339 time leave; a row of another width ends the reading with an error.
    The order of rows within the files is their order.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(path)
    if sorted(raw.columns) != sorted(CSV_COLUMNS):
        raise ValueError(f"expected the columns {CSV_COLUMNS}, found {raw.columns}")
    time = F.trim("time")
    df = raw.select(
        *[F.coalesce(clean(F.col(c)), F.lit("")).alias(c) for c in ("repo", "hash", "name", "email")],
        F.when(time.rlike(RFC3339), F.try_to_timestamp(time)).alias("ts"), F.monotonically_increasing_id().alias("row_ix"),
    )
    return df.where("repo <> '' AND name <> '' AND email <> '' AND hash <> '' AND ts IS NOT NULL").select(*SCHEMA.names)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, source: DataFrame, path: str) -> DataFrame:
    """The cache if it is there, else the source, which fills the cache; an empty path means no cache."""
    if not path:
        return source
    if not exists(spark, path):
        write_cache(source, path)
    return read_cache(spark, path)


def cache_key(text: str = DISCOVERY_SQL) -> str:
    """A 32-bit FNV-1a digest in hex of the query a cache was filled by."""
    h = 0x811C9DC5
    for byte in text.encode():
        h = (h ^ byte) * 0x01000193 & 0xFFFFFFFF
    return f"{h:08x}"


def read_research(spark: SparkSession, path: str, use_committer: bool = False) -> DataFrame:
    """(name, email, author_id, repository) of an export; rows with a null leave, committers are appended on request."""
    raw = spark.read.option("header", True).csv(path)

    def part(who: str) -> DataFrame:
        return raw.select(F.col(f"`{who}.name`").alias("name"), F.col(f"`{who}.email`").alias("email"), F.col("author_id"), F.col("repository")).dropna()

    rows = part("author").unionByName(part("committer")) if use_committer else part("author")
    return rows.select(clean(F.col("name")).alias("name"), clean(F.col("email")).alias("email"), "author_id", clean(F.col("repository")).alias("repository"))


def first_seen(rows: DataFrame, order: str) -> DataFrame:
    """Distinct (name, email) with the place of the first row that has them, numbered from 0."""
    from kinfold.operators.persons import dense_numbers

    first = rows.groupBy("name", "email").agg(F.min(order).alias("__first"))
    return dense_numbers(first, ["__first"], "ix").select((F.col("ix") - 1).alias("ix"), "name", "email")


__all__ = ["cache_key", "cached", "cleaned", "first_seen", "from_jdbc", "group_commits", "read_cache", "read_research", "write_cache"]
