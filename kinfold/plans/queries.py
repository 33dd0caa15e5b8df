"""The core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kinfold.functions import clean as C, predicates as P
from kinfold.functions.lists import FilterLists
from kinfold.operators import badrows, edges as E, evaluate, external, frequency, hotkeys, merge, metrics, popularity, resolve
from kinfold.operators.components import label_all
from kinfold.operators.persons import reversed_rows, with_key
from kinfold.plans.pipeline import Run, accounts, run_on
from kinfold.session import table, temporary_path, written
from kinfold.sources import signatures as S, sinks

HOT_SHARE = 0.01
LEARNED_NAMES, LEARNED_EMAILS = 5, 6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame) -> DataFrame:
    """Fractions to six places: sums of them depend on the order of rows in the last digits."""
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


# --- sources and scalar functions


@query
def sig_group_max(spark: SparkSession, d: str) -> DataFrame:
    """The source aggregate: one row for each repository, name and address."""
    return S.group_commits(table(spark, d, "commits")).select("repo", "name", "email", "hash", "ts")


def _distinct(spark: SparkSession, d: str, column: str) -> DataFrame:
    return table(spark, d, "commits").select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct()


def _scalar(name: str, column: str, out: str, f: Callable[[Column], Column]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _distinct(spark, d, column).select("value", f(F.col("value")).alias(out))

    run.__name__, run.__doc__ = name, f"{out} of every distinct {column}."
    query(run)


NAME, MAIL = "commit_author_name", "commit_author_email"
_scalar("strip_accents", NAME, "plain", C.strip_accents)
_scalar("collapse_blanks", NAME, "collapsed", C.collapse_blanks)
_scalar("clean_names", NAME, "cleaned", C.clean_name)
_scalar("clean_emails", MAIL, "cleaned", C.clean_email)
_scalar("clean_names_keep_case", NAME, "tidied", lambda c: C.tidy(c, False))
_scalar("remove_parens", NAME, "without", C.remove_parens)
_scalar("pred_capitalized", NAME, "flag", C.is_capitalized)
_scalar("pred_latin_letters", NAME, "flag", C.has_latin_letters)


def _mail_predicate(name: str, f: Callable[[Column, FilterLists], Column]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        lists = FilterLists.from_frame(table(spark, d, "filter_lists"))
        mails = _distinct(spark, d, MAIL).select(C.clean_email(F.col("value")).alias("email")).distinct()
        return mails.select("email", f(F.col("email"), lists).alias("flag"))

    run.__name__, run.__doc__ = name, f"{name} of every distinct cleaned address."
    query(run)


_mail_predicate("pred_multi_email", lambda c, _: P.is_multiple_email(c))
_mail_predicate("pred_domain", lambda c, x: x.is_ignored_domain(P.domain(c)))
_mail_predicate("pred_tld", lambda c, x: x.is_ignored_top_level(P.domain(c)))
_mail_predicate("pred_single_label", lambda c, _: P.is_single_label(P.domain(c)))
_mail_predicate("pred_ip", lambda c, _: P.is_ip_domain(P.domain(c)))
_mail_predicate("pred_listed_email", lambda c, x: x.is_listed_email(c))
_mail_predicate("pred_popular_email", lambda c, x: x.is_popular_email(c))
_mail_predicate("pred_ignored_email", lambda c, x: x.is_ignored_email(c))


def _name_predicate(name: str, f: Callable[[Column, FilterLists], Column]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        lists = FilterLists.from_frame(table(spark, d, "filter_lists"))
        names = _distinct(spark, d, NAME).select(C.clean_name(F.col("value")).alias("name")).distinct()
        return names.select("name", f(F.col("name"), lists).alias("flag"))

    run.__name__, run.__doc__ = name, f"{name} of every distinct cleaned name."
    query(run)


_name_predicate("pred_ignored_name", lambda c, x: x.is_ignored_name(c))
_name_predicate("pred_popular_name", lambda c, x: x.is_popular_name(c))


@query
def filter_lists_clean(spark: SparkSession, d: str) -> DataFrame:
    """The filter lists as loaded: cleaned, each entry once."""
    return table(spark, d, "filter_lists").select("list_name", C.clean(F.col("entry")).alias("entry")).distinct()


@query
def signature_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every grouped signature as a label to read."""
    rows = S.group_commits(table(spark, d, "commits"))
    return rows.select("row_ix", C.signature_label(F.col("repo"), F.col("name"), F.col("email"), F.col("hash"), F.col("ts")).alias("label"))


@query
def csv_cache(spark: SparkSession, d: str) -> DataFrame:
    """Signatures written to the CSV cache and read from it again."""
    path = temporary_path(spark, f"signatures-{S.cache_key()}")
    return S.cached(spark, S.group_commits(table(spark, d, "commits")), path).select("repo", "name", "email", "hash", "ts")


# --- persons


@query
def people_filtered(spark: SparkSession, d: str) -> DataFrame:
    """The signatures that may identify somebody, numbered in order of loading, popular names scoped."""
    return run_on(spark, d).people.select("id", "name", "repo", "email", "hash", "sample_repo")


@query
def popular_scope(spark: SparkSession, d: str) -> DataFrame:
    """Persons whose popular name counts only within a repository."""
    return run_on(spark, d).people.where("repo <> ''").select("id", "name", "repo")


@query
def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """The key under which each person's name links."""
    return with_key(run_on(spark, d).people).select("id", "name_key")


@query
def name_freq(spark: SparkSession, d: str) -> DataFrame:
    """Recent and all signatures of every cleaned name."""
    run = run_on(spark, d)
    return frequency.frequencies(run.signatures, "name", run.settings.cutoff)


@query
def email_freq(spark: SparkSession, d: str) -> DataFrame:
    """Recent and all signatures of every cleaned address."""
    run = run_on(spark, d)
    return frequency.frequencies(run.signatures, "email", run.settings.cutoff)


@query
def reversed_index(spark: SparkSession, d: str) -> DataFrame:
    """The set of persons of every address and every name, a row for each member, so that no set has to fit into one."""
    return reversed_rows(run_on(spark, d).people, ["email", "name"])


@query
def reversed_index_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The number, first and last of these persons."""
    rows = reversed_rows(run_on(spark, d).people, ["email", "name"])
    return rows.groupBy("attribute", "value").agg(F.count("id").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Distinct pairs of name and address, numbered by first sight."""
    return S.first_seen(run_on(spark, d).people, "id")


@query
def popular_learned_names(spark: SparkSession, d: str) -> DataFrame:
    """Names seen with at least five addresses."""
    run = run_on(spark, d)
    return popularity.cooccurring(run.signatures, "name", "email", LEARNED_NAMES, ">=", run.settings.lists.is_ignored_name, run.settings.lists.is_ignored_email)


@query
def popular_learned_emails(spark: SparkSession, d: str) -> DataFrame:
    """Addresses seen with at least six names."""
    run = run_on(spark, d)
    return popularity.cooccurring(run.signatures, "email", "name", LEARNED_EMAILS, ">=", run.settings.lists.is_ignored_email, run.settings.lists.is_ignored_name)


# --- linking


@query
def email_edges(spark: SparkSession, d: str) -> DataFrame:
    """Star edges by address: each later person and the first."""
    run = run_on(spark, d)
    return E.first_of_key(E.email_rows(run.people, run.settings.lists), ["email"])


@query
def name_edges(spark: SparkSession, d: str) -> DataFrame:
    """Star edges by name key: each later person and the first."""
    run = run_on(spark, d)
    return E.first_of_key(E.name_rows(run.people, run.settings.lists), ["name_key"])


@query
def email_components(spark: SparkSession, d: str) -> DataFrame:
    """Components by address alone."""
    return run_on(spark, d).email_labels()


@query
def all_components(spark: SparkSession, d: str) -> DataFrame:
    """Components by address and name, no limit."""
    return run_on(spark, d).full_labels()


def _unlimited(spark: SparkSession, d: str) -> Run:
    return run_on(spark, d, max_identities=None)


@query
def component_stats(spark: SparkSession, d: str) -> DataFrame:
    """Number, mean, deviation and maximum of the sizes of components."""
    return _rounded(merge.component_statistics(run_on(spark, d).full_labels()))


@query
def merged_identities(spark: SparkSession, d: str) -> DataFrame:
    """The merged person of every component, its names and addresses joined to text."""
    run = _unlimited(spark, d)
    rows = merge.merged(run.stored_people, run.labels)
    return rows.select("id", F.concat_ws("|", "names.key").alias("names"), F.concat_ws("|", "emails").alias("emails"), "n_persons")


@query
def person_labels(spark: SparkSession, d: str) -> DataFrame:
    """The merged person of every component as a label to read."""
    run = _unlimited(spark, d)
    return merge.merged(run.stored_people, run.labels).select("id", C.person_label(F.col("external_id"), F.col("names.key"), F.col("emails")).alias("label"))


@query
def aliases(spark: SparkSession, d: str) -> DataFrame:
    """The alias table."""
    return _unlimited(spark, d).aliases()


@query
def primary_name(spark: SparkSession, d: str) -> DataFrame:
    """The primary name of every identity."""
    return _unlimited(spark, d).primary("name")


@query
def primary_email(spark: SparkSession, d: str) -> DataFrame:
    """The primary address of every identity."""
    return _unlimited(spark, d).primary("email")


@query
def identities(spark: SparkSession, d: str) -> DataFrame:
    """The identity table."""
    return sinks.identity_rows(_unlimited(spark, d).identities())


@query
def limit_fastpath(spark: SparkSession, d: str) -> DataFrame:
    """Under the identity limit: the components too small for any check to fail."""
    return run_on(spark, d).labels.where("NOT replayed").select("id", "component")


@query
def limited_components(spark: SparkSession, d: str) -> DataFrame:
    """Components under the identity limit."""
    return run_on(spark, d).labels.select("id", "component")


@query
def limited_components_4(spark: SparkSession, d: str) -> DataFrame:
    """Components under a limit of four, which many components reach."""
    return run_on(spark, d, max_identities=4).labels.select("id", "component", "replayed")


@query
def limited_identities(spark: SparkSession, d: str) -> DataFrame:
    """The identity table under the identity limit."""
    return sinks.identity_rows(run_on(spark, d).identities())


@query
def research_union_find(spark: SparkSession, d: str) -> DataFrame:
    """Components of distinct pairs of name and address, ids by first sight, popular names not scoped but left out."""
    run = run_on(spark, d)
    lists = run.settings.lists
    pairs = S.first_seen(run.people, "id").withColumnRenamed("ix", "id")
    return label_all(pairs, E.stars((pairs.where(~lists.is_popular_email(F.col("email"))), "email"), (pairs.where(~lists.is_popular_name(F.col("name"))), "name")))


# --- external accounts


@query
def ext_accounts(spark: SparkSession, d: str) -> DataFrame:
    """Persons with the account their address is known to have, '' for none."""
    return run_on(spark, d, matches=accounts(spark, d)).people.select("id", "email", "external_id")


@query
def ext_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The addresses without a known account, which alone link by address."""
    run = run_on(spark, d)
    return external.unmatched(run.people, accounts(spark, d))


@query
def ext_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Names seen with exactly one account and without one: their two firsts."""
    run = run_on(spark, d, matches=accounts(spark, d))
    return E.bridges(run.people, run.settings.lists)


@query
def ext_components(spark: SparkSession, d: str) -> DataFrame:
    """Components with accounts, under the identity limit."""
    return run_on(spark, d, matches=accounts(spark, d)).labels.select("id", "component")


# --- what results are for


@query
def resolve_commits(spark: SparkSession, d: str) -> DataFrame:
    """Every commit, the identity it belongs to and what decided it."""
    commits = table(spark, d, "commits").select("row_ix", F.col("repository_id").alias("repo"), F.col(NAME).alias("name"), F.col(MAIL).alias("email"))
    return resolve.resolve(commits, _unlimited(spark, d).aliases()).select("row_ix", "identity_id", "matched_by")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    run = run_on(spark, d)
    truth = accounts(spark, d).select(F.col("user").alias("truth_id"), F.col("email").alias("entity"))
    found = run.stored_people.join(run.email_labels(), "id").select(F.col("component").alias("found_id"), F.col("email").alias("entity"))
    return evaluate.score_pairs(truth, found)


@query
def eval_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of every account and component that share an address."""
    return _rounded(_scores(spark, d))


@query
def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    """Their plain averages."""
    return _rounded(evaluate.macro(_scores(spark, d)))


@query
def eval_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Their averages weighted by the size of the component."""
    return _rounded(evaluate.weighted(_scores(spark, d)))


def _identity_scores(spark: SparkSession, d: str) -> DataFrame:
    run = run_on(spark, d)
    return evaluate.identity_scores(run.stored_people, run.full_labels(), accounts(spark, d))


@query
def eval_identity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of every account and identity, linked by address and name, that share a name or an address."""
    return _rounded(_identity_scores(spark, d))


@query
def eval_identity_macro(spark: SparkSession, d: str) -> DataFrame:
    """Their plain averages."""
    return _rounded(evaluate.macro(_identity_scores(spark, d)))


@query
def eval_identity_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Their averages weighted by the size of the identity."""
    return _rounded(evaluate.weighted(_identity_scores(spark, d)))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    run = run_on(spark, d)
    people, labels, lists = run.stored_people, written(run.full_labels(), "labels"), run.settings.lists
    counts = metrics.signature_counts(run.raw, run.stored_signatures, people, lists).union(metrics.linking_counts(people, labels, lists))
    counts = counts.union(metrics.edge_counts(people, lists)).union(metrics.size_counts(labels)).union(metrics.account_counts(people, accounts(spark, d)))
    return counts.select("key", F.round("value", 6).alias("value"))


@query
def metrics_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a run."""
    return _counts(spark, d)


@query
def metrics_json(spark: SparkSession, d: str) -> DataFrame:
    """The counters of a run as one JSON object."""
    return metrics.as_json(_counts(spark, d))


@query
def tables_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Alias and identity tables written as Parquet and read back, as text."""
    run = _unlimited(spark, d)
    folder = temporary_path(spark, "tables")
    path = f"{folder}/tables.parquet"
    sinks.write_tables(run.aliases(), run.identities(), path)
    rows, _ = sinks.read_tables(spark, path)
    return rows.select("id", F.size("names").alias("n_names"), F.concat_ws("|", "emails").alias("emails"), "primary_name", "primary_email", "external_id")


# --- per-key results under skew, records that do not parse


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The values holding at least 1 percent of all rows of commits."""
    return hotkeys.hot_keys(table(spark, d, "commits"), HOT_SHARE).select("field", F.col("key").alias("hot_value"))


@query
def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    """Counts, repositories, first and last commit of every name and address."""
    return hotkeys.key_statistics(table(spark, d, "commits"))


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The records that fail, with the first reason that applies."""
    return badrows.failed_records(table(spark, d, "commit_lines"))


@query
def p6_valid(spark: SparkSession, d: str) -> DataFrame:
    """The records that give a valid signature, as rows of commits' columns."""
    return badrows.valid_records(table(spark, d, "commit_lines"))


FLAGSHIP = identities
