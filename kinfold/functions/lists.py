"""Filter lists: names and addresses that identify nobody, and popular ones that need a scope."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold.functions import predicates as P
from kinfold.functions.clean import clean
from kinfold.session import written

LISTS = ("domains", "top_level_domains", "names", "emails", "popular_emails", "popular_names")
#: Above this counted size a list is joined instead of standing in the plan.
INLINE = 10_000

# A small list of our own for use without any file.
DEFAULTS = {
    "domains": {"example.com", "localhost.localdomain", "none", "unknown"},
    "top_level_domains": {"localhost", "local", "localdomain", "lan", "internal", "test", "invalid"},
    "names": {"root", "admin", "administrator", "ubuntu", "unknown", "user", "nobody", "your name"},
    "emails": {"you@example.com", "root@localhost", "noreply@localhost"},
    "popular_emails": {"noreply@users.example", "a@a.a"},
    "popular_names": {"alex", "bob", "alice", "chris", "dev", "sam"},
}


@dataclass(frozen=True)
class FilterLists:
    """Six lists of cleaned values, each a set or, if large, a frame of one column. Nothing is in an empty list; null is in none."""

    domains: frozenset[str] | DataFrame = field(default_factory=frozenset)
    top_level_domains: frozenset[str] | DataFrame = field(default_factory=frozenset)
    names: frozenset[str] | DataFrame = field(default_factory=frozenset)
    emails: frozenset[str] | DataFrame = field(default_factory=frozenset)
    popular_emails: frozenset[str] | DataFrame = field(default_factory=frozenset)
    popular_names: frozenset[str] | DataFrame = field(default_factory=frozenset)

    def is_popular_email(self, email: Column) -> Column:
        return P.in_list(self.popular_emails)(email)

    def is_popular_name(self, key: Column) -> Column:
        return P.in_list(self.popular_names)(key)

    def is_ignored_name(self, name: Column) -> Column:
        return P.in_list(self.names)(F.lower(name))

    def is_listed_email(self, email: Column) -> Column:
        return P.in_list(self.emails)(email)

    def is_ignored_domain(self, dom: Column) -> Column:
        return P.in_list(self.domains)(P.domain(dom))

    def is_ignored_top_level(self, dom: Column) -> Column:
        return P.in_list(self.top_level_domains)(P.top_level(P.domain(dom)))

    def is_ignored_email(self, email: Column) -> Column:
        """No at sign, listed, several addresses, or a domain that is listed, reserved, without a dot or an IP address."""
        dom = F.coalesce(P.first_domain(email), F.lit(""))
        bad = self.is_ignored_domain(dom) | self.is_ignored_top_level(dom) | P.is_single_label(dom) | P.is_ip_domain(dom)
        return ~P.has_at(email) | self.is_listed_email(email) | P.is_multiple_email(email) | bad

    @classmethod
    def of(cls, lists: dict[str, set[str] | DataFrame]) -> FilterLists:
        found = {k: lists.get(k, ()) for k in LISTS}
        return cls(**{k: v if isinstance(v, DataFrame) else frozenset(v) for k, v in found.items()})

    @classmethod
    def defaults(cls) -> FilterLists:
        return cls.of(DEFAULTS)

    @classmethod
    def from_frame(cls, df: DataFrame, list_col: str = "list_name", entry_col: str = "entry", inline: int = INLINE) -> FilterLists:
        """Lists from rows (list, entry). Entries are cleaned; a list of more than ``inline`` of them stays a frame."""
        rows = df.where(F.col(list_col).isin(*LISTS)).select(F.col(list_col).alias("name"), clean(F.col(entry_col)).alias("entry")).dropna().distinct()
        found: dict[str, set[str] | DataFrame] = {}
        few = rows.limit(inline * len(LISTS) + 1).collect()
        if len(few) > inline * len(LISTS):  # not all of them: only lists counted to be small come to the driver
            sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
            large = [r[0] for r in sizes.where(F.col("n") > inline).collect()]
            found = {k: written(rows.where(F.col("name") == k).select("entry"), "list") for k in large}
            few = rows.where(~F.col("name").isin(*large)).collect()
        for name, entry in few:
            found.setdefault(name, set()).add(entry)
        return cls.of(found)


def read_list(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(list_name, entry) from a text file, compressed or not, one entry a line, cleaned."""
    return spark.read.text(path).select(F.lit(name).alias("list_name"), clean(F.col("value")).alias("entry")).distinct()


def read_lists(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """All lists of ``paths`` (list name to file) as one frame."""
    return reduce(DataFrame.unionByName, (read_list(spark, p, n) for n, p in sorted(paths.items())))

