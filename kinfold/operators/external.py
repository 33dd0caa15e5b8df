"""External accounts: a lookup of addresses, and what it means for linking."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kinfold.operators.limit import IdConflict
from kinfold.session import ship

log = logging.getLogger(__name__)


class Matcher(Protocol):
    """Finds the account of an address, or of a commit; None if there is none. Made once in each task.

    Any exception means that nothing was found; it is kept as the row's ``error``.
    """

    supports_commits: bool

    def by_email(self, email: str) -> str | None: ...

    def by_commit(self, email: str, repo: str, commit: str) -> str | None: ...

    def on_idle(self) -> None: ...


KEYS = ["email", "repo", "hash"]
MATCHES = "email string, repo string, hash string, user string, error string"


def questions(people: DataFrame, by_commit: bool) -> DataFrame:
    """(email, repo, hash): what a matcher is asked, each once. Without a commit, or a matcher that knows commits, the address alone."""
    use = F.lit(by_commit) & (F.col("hash") != "")
    rows = people.select("email", F.when(use, F.col("sample_repo")).otherwise("").alias("repo"), F.when(use, F.col("hash")).otherwise("").alias("hash"))
    return rows.distinct()


def lookup(people: DataFrame, make: Callable[[], Matcher], known: DataFrame | None = None) -> DataFrame:
    """(email, repo, hash, user, error) of every question about ``people`` that is not in ``known``; ``user`` is null where nothing is found.

    Each question is asked once per evaluation, so write the result before
    using it. ``known``: answers of earlier runs, with the columns of KEYS.
    """
    ship(people.sparkSession)
    fresh = questions(people, make().supports_commits)
    fresh = fresh.join(known.select(*KEYS), KEYS, "left_anti") if known is not None else fresh

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = make()
        for pdf in batches:
            users: list[str | None] = []
            errors: list[str | None] = []
            for e, r, h in zip(pdf["email"], pdf["repo"], pdf["hash"]):
                user = error = None
                try:
                    user = matcher.by_commit(e, r, h) if h else matcher.by_email(e)
                except Exception as x:  # a service that fails for one address must not end the run
                    error = f"{type(x).__name__}: {x}"
                    log.warning("no answer for %s: %s", e, error)
                users.append(user)
                errors.append(error)
            yield pdf.assign(user=pd.Series(users, dtype="object"), error=pd.Series(errors, dtype="object"))
        if hasattr(matcher, "on_idle"):
            matcher.on_idle()

    return fresh.mapInPandas(ask, MATCHES)


def _answers(matches: DataFrame) -> DataFrame:
    """(email, repo, hash, user) with one row for each question; blank repo and hash where the table has none."""
    blank = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in matches.columns else F.lit("")).alias(c)
    return matches.select("email", blank("repo"), blank("hash"), "user").groupBy(*KEYS).agg(F.min("user").alias("user"))


def with_answers(people: DataFrame, matches: DataFrame) -> DataFrame:
    """``people`` with ``user``: the answer for the person's own commit, else for the address; null for none."""
    answers = _answers(matches)
    own = answers.where("hash <> ''").select("email", F.col("repo").alias("sample_repo"), "hash", F.col("user").alias("__own"))
    plain = answers.where("hash = ''").select("email", F.col("user").alias("__plain"))
    out = people.join(plain, "email", "left")
    out = out.join(own, ["email", "sample_repo", "hash"], "left") if {"repo", "hash"} <= set(matches.columns) else out.withColumn("__own", F.lit(None).cast("string"))
    return out.withColumn("user", F.coalesce("__own", "__plain")).drop("__own", "__plain")


def with_accounts(people: DataFrame, matches: DataFrame, check: bool = True) -> DataFrame:
    """``people`` with ``external_id`` ('' for none). Two accounts of one person raise :class:`IdConflict`.

    Several users of one question count as the smallest.
    """
    out = with_answers(people, matches).withColumn("external_id", F.coalesce("user", F.lit(""))).drop("user")
    if check:
        kinds = out.where("external_id <> ''").groupBy("id").agg(F.min("external_id").alias("a"), F.max("external_id").alias("b"))
        if kinds.where("a <> b").limit(1).count():
            raise IdConflict("one person with two external ids")
    return out


def unmatched(people: DataFrame, matches: DataFrame) -> DataFrame:
    """(email): the addresses the lookup did not find for some person; only these link persons by address."""
    return with_answers(people, matches).where(F.col("user").isNull()).select("email").distinct()
