"""Command line: match the identities of a commits table and write the alias and identity tables."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from kinfold.functions.lists import FilterLists
from kinfold.operators import metrics
from kinfold.operators.external import lookup
from kinfold.plans.pipeline import Run, Settings
from kinfold.session import written
from kinfold.sources import signatures as S, sinks

#: External matchers by name; an installation registers its own factories here.
MATCHERS: dict = {}


@dataclass
class Arguments:
    output: str
    commits: str = ""
    host: str = ""
    port: int = 3306
    database: str = ""
    url: str = ""
    bounds: list[str] = field(default_factory=list)
    user: str = "root"
    password: str = ""
    external: str = ""
    api_url: str = ""
    token: str = ""
    cache: str = ""
    external_cache: str = ""
    max_identities: int = 20
    months: int = 12
    min_count: int = 5
    lists: str = ""
    load_url: str = ""
    load_user: str = ""
    load_password: str = ""
    load_aliases: str = "aliases"
    load_identities: str = "identities"


def parse(argv: list[str] | None = None) -> Arguments:
    p = argparse.ArgumentParser(prog="kinfold", description=__doc__)
    p.add_argument("--output", required=True, help="path of the result; two tables are written beside it")
    p.add_argument("--commits", default="", help="Parquet table of commits; without it the database is read")
    p.add_argument("--host", default="")
    p.add_argument("--port", type=int, default=3306)
    p.add_argument("--database", default="", help="the database that holds the table of commits")
    p.add_argument("--url", default="", help="JDBC address of the database, in place of host, port and database")
    p.add_argument("--bounds", nargs="*", default=[], help="repositories at which the database's table is cut into parts read side by side")
    p.add_argument("--user", default="root")
    p.add_argument("--password", default="")
    p.add_argument("--external", default="", help="name of a registered matcher")
    p.add_argument("--api-url", default="")
    p.add_argument("--token", default="")
    p.add_argument("--cache", default="", help="CSV cache of signatures; empty for none")
    p.add_argument("--external-cache", default="")
    p.add_argument("--max-identities", type=int, default=20, help="names no longer link where either side has as many addresses and names")
    p.add_argument("--months", type=int, default=12, help="what counts as recent")
    p.add_argument("--min-count", type=int, default=5, help="recent signatures from which on they decide the primary values")
    p.add_argument("--lists", default="", help="Parquet table (list_name, entry) of filter lists")
    p.add_argument("--load-url", default="", help="JDBC address of a database that both tables are loaded into after the run")
    p.add_argument("--load-user", default="")
    p.add_argument("--load-password", default="")
    p.add_argument("--load-aliases", default="aliases", help="name of the table of aliases there")
    p.add_argument("--load-identities", default="identities", help="name of the table of identities there")
    args = Arguments(**vars(p.parse_args(argv)))
    if args.external and args.external not in MATCHERS:
        p.error(f"unknown matcher {args.external}; known: {sorted(MATCHERS)}")
    if not (args.commits or args.host or args.url):
        p.error("one of --commits, --host and --url is needed")
    return args


def source(spark: SparkSession, args: Arguments) -> DataFrame:
    if args.cache and S.exists(spark, args.cache):
        return S.read_cache(spark, args.cache)
    if args.commits:
        raw = S.group_commits(spark.read.parquet(args.commits))
    else:
        url = args.url or f"jdbc:mysql://{args.host}:{args.port}/{args.database}"
        raw = S.from_jdbc(spark, url, {"user": args.user, "password": args.password}, args.bounds)
    return S.cached(spark, raw, args.cache)


def run(spark: SparkSession, args: Arguments, as_of: datetime | None = None) -> tuple[str, str]:
    """The whole run; returns the two paths and prints the counters as JSON."""
    lists = FilterLists.from_frame(spark.read.parquet(args.lists)) if args.lists else FilterLists.defaults()
    settings = Settings(as_of or datetime.now(timezone.utc).replace(tzinfo=None), args.months, args.min_count, args.max_identities, lists)
    job = Run(source(spark, args), settings)
    if args.external:
        known = sinks.read_match_cache(spark, args.external_cache) if args.external_cache and S.exists(spark, args.external_cache) else None
        make, api_url, token = MATCHERS[args.external], args.api_url, args.token
        fresh = written(lookup(job.stored_people, lambda: make(api_url, token), known), "matches")  # asked once, whatever reads it
        if args.external_cache:
            sinks.match_cache(fresh, args.external_cache)
        answers = fresh.select(*sinks.MATCH_CACHE.names)
        job = Run(job.raw, settings, answers.unionByName(known) if known is not None else answers)
    paths = sinks.write_tables(job.aliases(), job.identities(), args.output, args.external)
    counts = metrics.signature_counts(job.raw, job.stored_signatures, job.stored_people, lists).union(metrics.linking_counts(job.stored_people, job.labels, lists))
    counts = counts.union(metrics.limited_edge_counts(job.stored_people, job.labels, lists)).union(metrics.size_counts(job.labels))
    if job.matches is not None:
        counts = counts.union(metrics.account_counts(job.stored_people, job.matches))
    print(metrics.as_json(counts).first()[0])
    if args.load_url:
        properties = {"user": args.load_user, "password": args.load_password}
        for path, name in zip(paths, (args.load_aliases, args.load_identities)):
            sinks.to_database(spark.read.parquet(path), args.load_url, name, properties)
    return paths


__all__ = ["Arguments", "MATCHERS", "parse", "run"]


def main() -> None:
    run(SparkSession.builder.appName("kinfold").getOrCreate(), parse())


if __name__ == "__main__":
    main()
