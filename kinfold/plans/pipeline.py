"""The batch run: signatures to persons, components, identities and aliases."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinfold.functions.lists import FilterLists
from kinfold.functions.predicates import recent_cutoff
from kinfold.operators import edges as E, external, frequency, limit as L, merge
from kinfold.operators.components import label_all
from kinfold.operators.persons import people_from, with_key
from kinfold.session import table, written
from kinfold.sources import signatures as S


@dataclass(frozen=True)
class Settings:
    """What a run depends on besides its tables."""

    as_of: datetime
    months: int = 12
    min_count: int = 5
    max_identities: int | None = L.DEFAULT_LIMIT
    lists: FilterLists = field(default_factory=FilterLists.defaults)

    @property
    def cutoff(self) -> datetime:
        return recent_cutoff(self.as_of, self.months)


@dataclass
class Run:
    """The steps of one run over raw signatures (repo, name, email, hash, ts, row_ix); each is planned when first asked for."""

    raw: DataFrame
    settings: Settings
    matches: DataFrame | None = None

    def __post_init__(self) -> None:
        self._kept: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def signatures(self) -> DataFrame:
        return self._once("signatures", lambda: S.cleaned(self.raw))

    @property
    def stored_signatures(self) -> DataFrame:
        """``signatures`` written once: numbering and the primary values pass over them several times."""
        return self._once("stored signatures", lambda: written(self.signatures, "signatures"))

    @property
    def people(self) -> DataFrame:
        def make() -> DataFrame:
            people = people_from(self.stored_signatures, self.settings.lists)
            return external.with_accounts(people, self.matches, check=False) if self.matches is not None else people.withColumn("external_id", F.lit(""))

        return self._once("people", make)

    @property
    def stored_people(self) -> DataFrame:
        """``people`` written once, for the several passes of linking."""
        return self._once("stored", lambda: written(self.people, "people"))

    @property
    def unmatched(self) -> DataFrame | None:
        return external.unmatched(self.stored_people, self.matches) if self.matches is not None else None

    def email_labels(self) -> DataFrame:
        """Components by address alone."""
        people = self.stored_people
        return label_all(people, E.star_edges(E.email_rows(people, self.settings.lists, self.unmatched), ["email"]))

    def full_labels(self) -> DataFrame:
        """Components by address and name, without a limit."""
        people, lists = self.stored_people, self.settings.lists
        return label_all(people, E.stars((E.email_rows(people, lists, self.unmatched), "email"), (E.name_rows(people, lists), "name_key")))

    @property
    def labels(self) -> DataFrame:
        """Components as the settings want them."""

        def make() -> DataFrame:
            if self.settings.max_identities is None and self.matches is None:
                return written(self.full_labels().select("id", "component", F.lit(False).alias("replayed"), F.lit(None).cast("long").alias("n_edges")), "labels")
            limit = self.settings.max_identities or 1 << 62
            return written(L.limited_components(self.stored_people, self.settings.lists, limit, self.unmatched), "labels")

        return self._once("labels", make)

    def primary(self, column: str) -> DataFrame:
        """(id, value) of the primary name or address of each identity."""
        rows = _value_rows(self.stored_people, self.labels, column)
        stats = frequency.frequencies(self.stored_signatures, column, self.settings.cutoff)
        return frequency.primary_values(rows, stats, self.settings.min_count)

    def identities(self) -> DataFrame:
        """(id, primary_name, primary_email, external_id) of each identity: names and addresses in one pass."""
        one = lambda kind, key: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"), F.col(key).alias("key"))
        pairs = F.explode(F.array(one("name", "name_key"), one("email", "email"))).alias("p")
        rows = with_key(self.stored_people).join(self.labels.select("id", "component"), "id").select(F.col("component").alias("id"), "external_id", pairs)
        values = rows.groupBy("id", "p.kind", "p.value", "p.key").agg(F.max("external_id").alias("external_id"))
        stats = frequency.all_frequencies(self.stored_signatures, ["name", "email"], self.settings.cutoff)
        best = frequency.primary_values(values, stats, self.settings.min_count, ["kind"], ["external_id"])
        of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("value"))).alias(f"primary_{kind}")
        return best.groupBy("id").agg(of("name"), of("email"), F.max("external_id").alias("external_id"))

    def aliases(self) -> DataFrame:
        return merge.aliases(self.stored_people, self.labels)


def _value_rows(people: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """(id, value, key) of each identity: distinct addresses, or names once for every scope."""
    rows = with_key(people).join(labels.select("id", "component"), "id")
    key = F.col("name_key") if column == "name" else F.col(column)
    return rows.select(F.col("component").alias("id"), F.col(column).alias("value"), key.alias("key")).distinct()


def accounts(spark: SparkSession, d: str, provider: str = "githarbor") -> DataFrame:
    """(email, user) known from Person records with an account of the provider."""
    from kinfold.functions.clean import clean

    rows = table(spark, d, "people").where(F.col("external_id_provider") == provider)
    mails = rows.select(F.explode("emails").alias("e"), F.col("external_id").alias("user")).select(clean(F.col("e")).alias("email"), "user")
    return mails.where("email <> '' AND user IS NOT NULL").groupBy("email").agg(F.min("user").alias("user"))


def run_on(spark: SparkSession, d: str, settings: Settings | None = None, matches: DataFrame | None = None, **changes) -> Run:
    """A run over the commits and filter lists below ``d``."""
    lists = FilterLists.from_frame(table(spark, d, "filter_lists"))
    settings = settings or Settings(**({"as_of": datetime(2020, 8, 1), "lists": lists} | changes))
    return Run(S.group_commits(table(spark, d, "commits")), settings, matches)
