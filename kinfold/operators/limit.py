"""The identity limit: names link in the order of ids only while both sides are small enough.

The rule is sequential by definition, but it never reaches across components
taken without it. Components too small for any check to fail are taken as they
are; only the rest are replayed, each on its own.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinfold.functions.lists import FilterLists
from kinfold.operators.components import label_all
from kinfold.operators.edges import email_rows, name_rows, stars
from kinfold.operators.persons import with_key
from kinfold.operators.skew import lookup_join
from kinfold.session import ship, written

DEFAULT_LIMIT = 20
NEVER = 1 << 62


class IdConflict(ValueError):
    """One component with two external ids."""


class Side:
    """Union-find whose roots carry the addresses, name keys and external id of their component."""

    def __init__(self, ids: list[int], limit: int) -> None:
        self.top = {i: i for i in ids}
        self.mails: dict[int, set[str]] = {i: set() for i in ids}
        self.keys: dict[int, set[str]] = {i: set() for i in ids}
        self.external = dict.fromkeys(ids, "")
        self.edges = dict.fromkeys(ids, 0)
        self.limit = limit
        #: For a root that has reached the limit, the person whose link did it; 0 where links by address did.
        self.full: dict[int, int] = {}

    def root(self, i: int) -> int:
        while self.top[i] != i:
            self.top[i] = self.top[self.top[i]]
            i = self.top[i]
        return i

    def size(self, i: int) -> int:
        r = self.root(i)
        return len(self.mails[r]) + len(self.keys[r])

    def link(self, a: int, b: int, at: int = 0) -> None:
        """One edge, set when ``at`` is looked at; ``b`` is the later person and counts it."""
        later = b
        a, b = sorted((self.root(a), self.root(b)))
        if a == b:
            self.edges[later] += 1
            return
        x, y = self.external[a], self.external[b]
        if x and y and x != y:
            raise IdConflict(f"different external ids: {x} {y}")
        self.edges[later] += 1
        self.top[b] = a
        self.external[a] = x or y
        self.mails[a] |= self.mails.pop(b)
        self.keys[a] |= self.keys.pop(b)
        ends = [self.full.pop(r) for r in (a, b) if r in self.full]
        if ends or self.size(a) >= self.limit:
            self.full[a] = min(ends, default=at)


def replay(rows: list[tuple], limit: int) -> dict[int, tuple[int, int, int]]:
    """Of each id the component, how many edges were set for it, and the person from which on its name would not link again. A row: (id, external id, name key, address, whether the name links, whether the address links).

    Address and external links come first and are exempt from the limit; then
    names in the order of ids, in a bucket of key and current external id whose
    first person is the anchor; then names with one external id and none.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[3]))
    side = Side([r[0] for r in rows], limit)
    for i, external, key, mail, _, _ in rows:
        if external and side.external[i] and external != side.external[i]:
            raise IdConflict(f"different external ids: {side.external[i]} {external}")
        side.external[i] = external or side.external[i]
        side.mails[i].add(mail)
        side.keys[i].add(key)
    first: dict[tuple[str, str], int] = {}
    for i, external, _, mail, _, mail_links in rows:
        for key, links in ((("x", external), external), (("m", mail), mail_links)):
            if links and (anchor := first.setdefault(key, i)) != i:
                side.link(anchor, i)
    buckets: dict[str, dict[str, int]] = {}
    for i, _, key, _, name_links, _ in rows:
        if not name_links:
            continue
        own = buckets.setdefault(key, {})
        anchor = own.setdefault(side.external[side.root(i)], i)
        if anchor != i and side.size(i) < limit and side.size(anchor) < limit:
            side.link(anchor, i, i)
    for key in sorted(buckets):
        own = buckets[key]
        if len(own) == 2 and "" in own:
            a, b = own.values()
            if side.size(a) < limit and side.size(b) < limit:
                try:
                    side.link(a, b, NEVER)
                except IdConflict:
                    pass
    until = {i: 0 for i, *_ in rows}
    for i, _, key, _, name_links, _ in rows:
        if name_links:
            until[i] = min(side.full.get(side.root(x), NEVER) for x in (i, buckets[key].get("", i)))
    return {r[0]: (side.root(r[0]), side.edges[r[0]], until[r[0]]) for r in rows}


def limited_components(people: DataFrame, lists: FilterLists, limit: int = DEFAULT_LIMIT, unmatched: DataFrame | None = None) -> DataFrame:
    """(id, component, replayed, n_edges) of every person under the identity limit; ``component`` is the smallest id.

    ``n_edges``: the links set for a replayed person, each counted at the later
    of its two; null for others, whose links are all those of their keys. Where
    nobody of a component has an external id, of persons with the same name key
    and linking address only the first is replayed: later ones find nothing
    that it did not find.

    ``people`` may have a column ``external_id`` ('' for none). Two external
    ids in one component of addresses raise :class:`IdConflict`.
    """
    ship(people.sparkSession)
    if "external_id" not in people.columns:
        people = people.withColumn("external_id", F.lit(""))
    mails, names = email_rows(people, lists, unmatched), name_rows(people, lists)
    edges = stars((mails, "email"), (names, "name_key"), (people.where("external_id <> ''"), "external_id"))
    super_ = written(label_all(people.select("id").distinct(), edges), "super")
    rows = (
        with_key(people).select("id", "external_id", "name_key", "email")
        .join(names.select("id", "name_key", F.lit(True).alias("name_links")).distinct(), ["id", "name_key"], "left")
        .join(mails.select("id", "email", F.lit(True).alias("mail_links")).distinct(), ["id", "email"], "left")
        .fillna(False, ["name_links", "mail_links"]).join(super_, "id")
    )
    rows = written(rows, "limit rows")
    sizes = rows.groupBy("component").agg(F.count_distinct("email").alias("m"), F.count_distinct("name_key").alias("k"), F.max("external_id").alias("x"))
    slow = sizes.where((F.col("m") + F.col("k") >= limit) | (F.col("x") != "")).select("component", (F.col("x") == "").alias("plain"))
    slow = written(slow, "slow")
    columns = ["id", "external_id", "name_key", "email", "name_links", "mail_links"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = replay(list(pdf[columns].itertuples(index=False, name=None)), limit)
        return pd.DataFrame([(i, *v) for i, v in found.items()], columns=["id", "component", "n_edges", "until"])

    fast = super_.join(slow, "component", "left_anti").select("id", "component", F.lit(False).alias("replayed"), F.lit(None).cast("long").alias("n_edges"))
    held = written(rows.join(slow, "component"), "held")
    # links by address are exempt, so of persons with one name key and one linking address the first stands for all
    alike = held.where("plain AND mail_links")
    firsts = written(alike.groupBy("component", "name_key", "email", "name_links").agg(F.min("id").alias("id")), "firsts")
    alone = held.where("NOT (plain AND mail_links)").select("component", *columns)
    asked = firsts.select("component", "id", F.lit("").alias("external_id"), "name_key", "email", "name_links", F.lit(True).alias("mail_links")).union(alone)
    found = written(asked.groupBy("component").applyInPandas(run, "id long, component long, n_edges long, until long"), "replay")
    known = firsts.drop("component").join(found, "id").select("name_key", "email", F.col("id").alias("first"), F.col("component").alias("top"), "until")
    later = lookup_join(written(alike.select("id", "name_key", "email", "name_links"), "alike"), known, ["name_key", "email"]).where("id <> first")
    again = F.when(F.col("name_links") & (F.col("id") < F.col("until")), 2).otherwise(1).cast("long")
    slow_rows = found.select("id", "component", "n_edges").union(later.select("id", F.col("top"), again))
    return fast.union(slow_rows.select("id", "component", F.lit(True), "n_edges"))
