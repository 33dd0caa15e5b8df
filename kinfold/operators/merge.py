"""Merging the persons of a component, and the tables of aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinfold.operators.edges import propagate_ids
from kinfold.operators.persons import with_key


class ConflictError(ValueError):
    """Persons with different external ids in one component."""


def aliases(people: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, email, name, repo): one row for each address and one for each scoped name of every identity."""
    rows = people.join(labels.select("id", "component"), "id")
    mails = rows.select(F.col("component").alias("id"), "email", F.lit("").alias("name"), F.lit("").alias("repo"))
    names = rows.select(F.col("component").alias("id"), F.lit("").alias("email"), "name", "repo")
    return mails.distinct().unionByName(names.distinct())


def merged(people: DataFrame, labels: DataFrame, check: bool = True) -> DataFrame:
    """(id, names, emails, external_id, n_persons): the smallest id survives with sorted distinct names and addresses.

    ``names`` holds (key, name, repo). Differing external ids raise
    :class:`ConflictError` unless ``check`` is off; then the largest is kept.
    """
    if "external_id" not in people.columns:
        people = people.withColumn("external_id", F.lit(""))
    rows = with_key(people).join(labels.select("id", "component"), "id")
    ids = propagate_ids(rows.select("component", "external_id"))
    if check and ids.where("conflict").limit(1).count():
        raise ConflictError("persons with different external ids in one component")
    out = rows.groupBy("component").agg(
        F.array_sort(F.collect_set(F.struct(F.col("name_key").alias("key"), "name", "repo"))).alias("names"),
        F.array_sort(F.collect_set("email")).alias("emails"),
        F.count_distinct("id").alias("n_persons"),
    )
    return out.join(ids.select("component", "external_id"), "component").withColumnRenamed("component", "id")


def component_statistics(labels: DataFrame) -> DataFrame:
    """(n_components, size_mean, size_std, size_max): sample deviation, 0 for a single component or none."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_components"), zero(F.avg("n")).alias("size_mean"), zero(F.stddev_samp("n")).alias("size_std"),
        F.coalesce(F.max("n"), F.lit(0)).alias("size_max"),
    )
