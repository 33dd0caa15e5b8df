"""Persons from signatures: filtering, sequential ids, scoping of popular names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from kinfold.functions.clean import name_key
from kinfold.functions.lists import FilterLists

BUCKET = 1 << 20


def dense_numbers(df: DataFrame, order: list[str], name: str = "id") -> DataFrame:
    """``name`` = 1, 2, 3 ... in the given total order, without sorting everything in one task.

    One integer column is cut into ranges whose sizes are summed up (a few
    rows); any other order is split into ranges by Spark first. Either way only
    ranges are sorted.
    """
    if len(order) == 1 and df.schema[order[0]].dataType.typeName() in ("long", "integer"):
        parts = df.withColumn("__part", F.floor(F.col(order[0]) / BUCKET))
    else:
        from kinfold.session import written

        parts = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id().cast("long")), "ranges")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # one row for each range: a window without partitions is small here
    before = sizes.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return parts.withColumn("__in", inside).join(before, "__part").withColumn(name, F.col("__before") + F.col("__in")).drop("__part", "__in", "__before")


def people_from(signatures: DataFrame, lists: FilterLists) -> DataFrame:
    """(id, name, repo, email, hash, sample_repo, ts): the cleaned signatures that may identify somebody, numbered in order.

    Signatures with an ignored address or name leave before ids are given. A
    popular name keeps its repository as scope, any other has ``repo`` ''.
    """
    kept = signatures.where(~lists.is_ignored_email(F.col("email")) & ~lists.is_ignored_name(F.col("name")))
    scope = F.when(lists.is_popular_name(F.col("name")), F.col("repo")).otherwise("")
    return dense_numbers(kept, ["row_ix"]).select("id", "name", scope.alias("repo"), "email", "hash", F.col("repo").alias("sample_repo"), "ts")


def reversed_rows(people: DataFrame, attributes: list[str]) -> DataFrame:
    """(attribute, value, id): each person once under each value it has."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).alias("value")) for a in attributes])).alias("p")
    return people.select("id", pairs).select("p.attribute", "p.value", "id").where(F.col("value").isNotNull()).distinct()


def with_key(people: DataFrame) -> DataFrame:
    """``name_key`` added: the name, with its scope if it has one."""
    return people.withColumn("name_key", name_key(F.col("name"), F.col("repo")))
