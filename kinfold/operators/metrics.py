"""Counters of a run as one (key, value) table, from aggregates rather than accumulators, which count retries twice."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, functions as F

from kinfold.functions.clean import changes_when_cleaned
from kinfold.functions.lists import FilterLists
from kinfold.operators.edges import email_rows, name_rows
from kinfold.operators.external import with_answers
from kinfold.operators.merge import component_statistics
from kinfold.operators.persons import with_key


class Metrics:
    """Named values of a run; a counter that was never raised is absent."""

    def __init__(self) -> None:
        self.values: dict[str, float | int | str] = {}

    def set(self, key: str, value: float | int | str) -> None:
        if isinstance(value, float) and math.isnan(value):
            raise ValueError(f"{key} is not a number")
        self.values[key] = value

    def increment(self, key: str, by: int = 1) -> int:
        self.values[key] = int(self.values.get(key, 0)) + by
        return self.values[key]

    def get(self, key: str):
        return self.values.get(key)

    def reset(self) -> None:
        self.values.clear()

    def to_json(self) -> str:
        return json.dumps(self.values, sort_keys=True)


def signature_counts(raw: DataFrame, cleaned: DataFrame, people: DataFrame, lists: FilterLists) -> DataFrame:
    """(key, value) of reading and filtering. ``raw``: as stored, ``cleaned``: before filtering, ``people``: after."""
    mail, name = F.col("email"), F.col("name")
    bad_mail = lists.is_ignored_email(mail)
    a = raw.agg(F.count_if(changes_when_cleaned(name)).alias("clean names"), F.count_if(changes_when_cleaned(mail)).alias("clean emails"))
    b = cleaned.agg(
        F.count(F.lit(1)).alias("people found"), F.count_if(bad_mail).alias("ignored emails"),
        F.count_if(~bad_mail & lists.is_ignored_name(name)).alias("ignored names"), F.count_if(lists.is_popular_name(name)).alias("popular names"),
    )
    c = people.agg(F.count(F.lit(1)).alias("people after filtering"), F.count_if(lists.is_popular_email(mail)).alias("popular emails found"))
    return tall(a).union(tall(b)).union(tall(c))


def linking_counts(people: DataFrame, labels: DataFrame, lists: FilterLists) -> DataFrame:
    """(key, value) of linking."""
    popular = with_key(people).agg(F.count_if(lists.is_popular_name(F.col("name_key"))).alias("popular names found"))
    mails = email_rows(people, lists).agg(F.count_distinct("email").alias("people matched by email"))
    names = name_rows(people, lists).agg(F.count_distinct("name_key").alias("people matched by name"))
    after = labels.agg(F.count_distinct("component").alias("people after reduce"))
    return tall(popular).union(tall(mails)).union(tall(names)).union(tall(after))


def edge_counts(people: DataFrame, lists: FilterLists) -> DataFrame:
    """(key, value): the links set when no limit holds any back, one for each later person of an address or name key."""
    mails = email_rows(people, lists).agg((F.count("email") - F.count_distinct("email")).alias("n"))
    names = name_rows(people, lists).agg((F.count("name_key") - F.count_distinct("name_key")).alias("n"))
    return tall(mails.union(names).agg(F.sum("n").alias("graph edges")))


def limited_edge_counts(people: DataFrame, labels: DataFrame, lists: FilterLists) -> DataFrame:
    """(key, value): the links set under the identity limit: those of replayed persons as counted, of others all that their keys give."""
    others = people.join(labels.where("NOT replayed").select("id"), "id", "left_semi")
    rows = edge_counts(others, lists).select("value").union(labels.where("replayed").select(F.sum("n_edges").cast("double")))
    return rows.agg(F.sum("value").alias("value")).select(F.lit("graph edges").alias("key"), "value")


def size_counts(labels: DataFrame) -> DataFrame:
    """(key, value): mean, deviation and maximum of the sizes of components."""
    row = component_statistics(labels)
    return tall(row.select(*[F.col(f"size_{x}").alias(f"connected component size {x}") for x in ("mean", "std", "max")]))


def account_counts(people: DataFrame, matches: DataFrame) -> DataFrame:
    """(key, value) of an external lookup over the addresses of ``people``."""
    asked = with_answers(people, matches).select("email", "user").distinct()
    missing = F.when(F.col("user").isNull(), F.col("email"))
    found = F.when(F.col("user").isNotNull(), F.col("email"))
    return tall(asked.agg(
        F.count_distinct(found).alias("external API emails found"), F.count_distinct("user").alias("external API components"),
        F.count_distinct(missing).alias("external API emails not found"),
    ))


def tall(row: DataFrame) -> DataFrame:
    """One row of counters as (key, value) rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("double").alias("value")) for c in row.columns])).alias("p")
    return row.select(pairs).select("p.key", "p.value")


def as_json(counts: DataFrame) -> DataFrame:
    """(json): all counters that were raised, as one object."""
    return counts.where("value <> 0").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))).alias("json"))
