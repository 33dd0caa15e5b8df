"""The operators that make identities of signatures, against hand-made cases and plain union-find."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from kinfold.functions.lists import FilterLists
from kinfold.operators import edges as E, evaluate, external, frequency, limit as L, merge, popularity, resolve
from kinfold.operators.components import components, label_all
from kinfold.operators.persons import dense_numbers, people_from
from kinfold.plans.pipeline import Run, Settings
from kinfold.sources import signatures as S, sinks

LISTS = FilterLists.of({"names": {"admin"}, "popular_names": {"bob", "alice"}, "popular_emails": {"popular@google.com"}, "domains": {"example.com"}})
PEOPLE = "id long, name string, repo string, email string, hash string, sample_repo string"


def people(spark, rows):
    return spark.createDataFrame([(i, n, r, e, "h", "r") for i, n, r, e in rows], PEOPLE)


def groups(rows):
    out = {}
    for i, c in rows:
        out.setdefault(c, set()).add(i)
    return sorted(map(sorted, out.values()))


def plain_components(pairs, ids):
    top = {i: i for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("local_edges", "hot_rows"), [(10**6, 10**6), (7, 10**6), (7, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, local_edges, hot_rows, seed):
    rnd = random.Random(seed)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 230)]
    df = spark.createDataFrame([*pairs, (7, None), (None, None)], "a long, b long")
    got = {r.id: r.component for r in components(df, local_edges, hot_rows).collect()}
    want = plain_components(pairs, {x for p in pairs for x in p})
    assert got == {i: c for i, c in want.items() if any(i in p and p[0] != p[1] for p in pairs)}
    assert label_all(spark.createDataFrame([(999,)], "id long"), df, local_edges=local_edges).collect() == [(999, 999)]


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_dense_numbers_keep_order(spark):
    df = spark.createDataFrame([(x * 700_000, chr(97 + x)) for x in range(20)], "row_ix long, c string")
    for order in (["row_ix"], ["c"]):
        got = [(r.id, r.c) for r in dense_numbers(df, order).orderBy("id").collect()]
        assert got == [(i + 1, chr(97 + i)) for i in range(20)]


COMMITS = [
    ("repo1", "Bob", "Bob@google.com", "aa", datetime(2020, 1, 1)), ("repo2", "Bob", "Bob@google.com", "bb", datetime(2018, 1, 1)),
    ("repo1", "Alice", "alice@google.com", "cc", datetime(2018, 1, 1)), ("repo1", "Bob", "Bob@google.com", "zz", datetime(2020, 1, 2)),
    ("repo1", "Bob", "bad@localhost", "dd", datetime(2020, 1, 1)), ("repo1", "Admin", "someone@google.com", "ee", datetime(2020, 1, 1)),
]


def commits(spark, rows=COMMITS):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_ix long, repository_id string, commit_author_name string, commit_author_email string, commit_hash string, commit_author_when timestamp")
    return df.withColumns({"id": F.lit("clash"), "name": F.lit("clash")})


def run(spark, rows=COMMITS, **changes):
    return Run(S.group_commits(commits(spark, rows)), Settings(**({"as_of": datetime(2020, 6, 1), "lists": LISTS, "min_count": 1} | changes)))


def test_end_to_end(spark, tmp_path):
    job = run(spark)
    assert job.people.count() == 3
    assert sorted(tuple(r) for r in sinks.identity_rows(job.identities()).collect()) == [(1, "bob", "bob@google.com", "", ""), (3, "alice", "alice@google.com", "", "")]
    assert sorted(tuple(r) for r in job.aliases().collect()) == [
        (1, "", "bob", "repo1"), (1, "", "bob", "repo2"), (1, "bob@google.com", "", ""), (3, "", "alice", "repo1"), (3, "alice@google.com", "", ""),
    ]
    path = str(tmp_path / "out.parquet")
    assert sinks.write_tables(job.aliases(), job.identities(), path)[0].endswith("out-aliases.parquet")
    rows, provider = sinks.read_tables(spark, path)
    assert provider == "" and {r.id: r.emails for r in rows.collect()} == {1: ["bob@google.com"], 3: ["alice@google.com"]}
    with pytest.raises(Exception, match="already exists"):
        sinks.write_tables(job.aliases(), job.identities(), path)


def test_empty_table(spark):
    job = run(spark, [])
    assert job.identities().collect() == [] and job.aliases().collect() == []


def test_nulls_and_blanks_leave(spark):
    job = run(spark, [("r", None, "a@google.com", "h", datetime(2020, 1, 1)), ("r", "x", None, "h", datetime(2020, 1, 1)), (None, "x", "a@google.com", "h", datetime(2020, 1, 1)), ("r", " ", "a@google.com", "h", datetime(2020, 1, 1)), ("r", "x", "a@google.com", "h", None)])
    assert job.people.count() == 0


def test_frequencies(spark):
    job = run(spark)
    got = {r.value: (r.recent, r.total) for r in frequency.frequencies(job.signatures, "name", job.settings.cutoff).collect()}
    assert got == {"alice": (0, 1), "admin": (1, 1), "bob": (2, 3)}


def test_primary_values(spark):
    values = spark.createDataFrame([(1, "b", "b"), (1, "a", "a"), (2, "c", "c"), (2, "d", "d"), (3, "e", "e")], "id long, value string, key string")
    stats = spark.createDataFrame([("a", 3, 3), ("b", 3, 9), ("c", 1, 2), ("d", 0, 5), ("e", 0, 1)], "value string, recent long, total long")
    assert {r.id: r.value for r in frequency.primary_values(values, stats, 5).collect()} == {1: "a", 2: "d", 3: "e"}
    assert {r.id: r.value for r in frequency.primary_values(values, stats, 0).collect()} == {1: "a", 2: "c", 3: ""}


LINKED = [(1, "bob 1", "", "b1@x.com"), (2, "bob 2", "", "b1@x.com"), (3, "al", "", "a@x.com"), (4, "al", "", "a2@x.com"), (5, "bob", "", "p@x.com"), (6, "bob", "r", "q@x.com"), (7, "bob", "r", "popular@google.com"), (8, "z", "", "popular@google.com")]


def test_linking_by_email_and_name(spark):
    df = people(spark, LINKED)
    got = groups((r.id, r.component) for r in L.limited_components(df, LISTS, 100).collect())
    assert got == [[1, 2], [3, 4], [5], [6, 7], [8]]


def test_identity_limit(spark):
    """Address links are exempt; a name links only while both sides are below the limit."""
    rows = [(1, "n1", "", "e1@x.com"), (2, "m1", "", "s@x.com"), (3, "m2", "", "s@x.com"), (4, "m3", "", "s@x.com"), (5, "n1", "", "s@x.com"), (6, "n1", "", "e6@x.com"), (7, "n1", "", "e7@x.com"), (8, "n8", "", "e8@x.com"), (9, "n8", "", "e9@x.com"), (10, "n8", "", "e9@x.com")]
    got = groups((r.id, r.component) for r in L.limited_components(people(spark, rows), LISTS, 4).collect())
    assert got == [[1, 6, 7], [2, 3, 4, 5], [8, 9, 10]]


@pytest.mark.parametrize("seed", range(3))
def test_fast_path_is_the_replay(spark, seed):
    """Splitting into components and skipping small ones changes nothing against one pass over everything."""
    rnd = random.Random(seed)
    rows = [(i, f"n{rnd.randrange(14)}", "", f"e{rnd.randrange(25)}@x.com") for i in range(1, 51)]
    rows += [(i, *rnd.choice(rows)[1:]) for i in range(51, 91)]
    for limit in (3, 5, 9):
        whole = L.replay([(i, "", n, e, True, True) for i, n, _, e in rows], limit)
        got = L.limited_components(people(spark, rows).repartition(5), LISTS, limit).collect()
        assert {r.id: r.component for r in got} == {i: c for i, (c, _, _) in whole.items()}
        assert sum(r.n_edges for r in got if r.replayed) == sum(whole[r.id][1] for r in got if r.replayed)


def test_accounts(spark):
    df = people(spark, [(1, "al", "", "a@x.com"), (2, "al", "", "b@x.com"), (3, "al", "", "c@x.com"), (4, "zed", "", "d@x.com"), (5, "zed", "", "e@x.com")])

    class Known:
        supports_commits = False

        def by_email(self, email):
            return {"a@x.com": "A", "b@x.com": "B", "d@x.com": "D"}.get(email)

    matches = external.lookup(df, Known)
    assert {r.email: r.user for r in matches.collect()} == {"a@x.com": "A", "b@x.com": "B", "c@x.com": None, "d@x.com": "D", "e@x.com": None}
    known = spark.createDataFrame([("a@x.com", "", "", "kept")], "email string, repo string, hash string, user string")
    assert {r.email for r in external.lookup(df, Known, known).collect()} == {"b@x.com", "c@x.com", "d@x.com", "e@x.com"}
    with_ids = external.with_accounts(df, matches)
    assert E.bridges(with_ids, LISTS).collect() == [("zed", 4, 5)]
    left = external.unmatched(df, matches)
    assert {r.email for r in left.collect()} == {"c@x.com", "e@x.com"}
    got = groups((r.id, r.component) for r in L.limited_components(with_ids, LISTS, 100, left).collect())
    assert got == [[1], [2], [3], [4, 5]]
    labels = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    with pytest.raises(merge.ConflictError):
        merge.merged(with_ids, labels)
    with pytest.raises(L.IdConflict):
        L.replay([(1, "A", "n", "m", False, True), (2, "B", "k", "m", False, True)], 9)


def test_merge_and_statistics(spark):
    df = people(spark, [(1, "b", "", "z@x.com"), (2, "a", "", "y@x.com"), (3, "c", "r", "q@x.com")])
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, component long")
    got = {r.id: ([n.key for n in r.names], r.emails, r.n_persons) for r in merge.merged(df, labels).collect()}
    assert got == {1: (["a", "b"], ["y@x.com", "z@x.com"], 2), 3: (["{c, r}"], ["q@x.com"], 1)}
    assert merge.component_statistics(labels).collect() == [(2, 1.5, pytest.approx(0.5**0.5), 2)]
    assert merge.component_statistics(labels.where("id < 0")).collect() == [(0, 0.0, 0.0, 0)]


def test_popularity(spark):
    df = spark.createDataFrame([("k", "1"), ("k", "2"), ("k", "2"), ("j", "1"), (None, "1"), ("k", None), ("skip", "1")], "k string, v string")
    assert popularity.cooccurring(df, "k", "v", 2).collect() == [("k", 2)]
    assert {r.key for r in popularity.cooccurring(df, "k", "v", 1, "==", ignored_key=lambda c: c == "skip").collect()} == {"j"}


def test_resolve(spark):
    aliases = spark.createDataFrame([(1, "a@x.com", "", ""), (2, "", "bob", "r1"), (3, "", "bob", ""), (4, "", "al", "")], "id long, email string, name string, repo string")
    rows = spark.createDataFrame([("r1", "Bob", "A@x.com"), ("r1", "BOB", "q"), ("r2", "bob", None), ("r", None, None)], "repo string, name string, email string")
    got = [(r.identity_id, r.matched_by) for r in resolve.resolve(rows, aliases).collect()]
    assert sorted(got, key=str) == sorted([(1, "email"), (2, "name in repository"), (3, "name"), (None, None)], key=str)


def test_scores(spark):
    truth = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "c"), (None, "z")], "truth_id string, entity string")
    found = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, "b")], "found_id long, entity string")
    scores = evaluate.score_pairs(truth, found)
    got = {(r.truth_id, r.found_id): (r.precision, r.recall) for r in scores.collect()}
    assert got == {("t", 1): (0.5, 0.5), ("u", 1): (0.5, 1.0), ("t", 2): (1.0, 0.5)}
    assert evaluate.macro(scores).first().precision == pytest.approx(2 / 3)
    assert evaluate.weighted(scores).first().precision == pytest.approx((0.5 * 2 + 0.5 * 2 + 1) / 5)


def test_scores_of_identities_show_a_wrong_merge_by_name(spark):
    df = people(spark, [(1, "ann", "", "a@x.io"), (2, "ann", "", "b@x.io"), (3, "ann lee", "", "a@x.io"), (4, "bob", "r", "c@x.io"), (5, "cy", "", "d@x.io")])
    accounts = spark.createDataFrame([("a@x.io", "A"), ("b@x.io", "B"), ("c@x.io", "C"), ("unseen@x.io", "C")], "email string, user string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)], "id long, component long")
    scores = evaluate.identity_scores(df, labels, accounts)
    got = {(r.truth_id, r.found_id): (r.common, r.truth_size, r.found_size, r.precision, r.recall) for r in scores.collect()}
    assert got == {("A", 1): (3, 3, 4, 0.75, 1.0), ("B", 1): (2, 2, 4, 0.5, 1.0), ("C", 4): (2, 2, 2, 1.0, 1.0)}
    assert evaluate.macro(scores).first().precision == pytest.approx(0.75)
    assert evaluate.weighted(scores).first().precision == pytest.approx(0.7)


def test_cache_round_trip(spark, tmp_path):
    raw = S.group_commits(commits(spark, [*COMMITS, ("r", 'Quo"ted, näme', "q@x.com", "h", datetime(2020, 1, 1, 2, 3, 4))]))
    path = str(tmp_path / "cache.csv")
    first, again = S.cached(spark, raw, path), S.cached(spark, None, path)
    pick = lambda df: sorted(tuple(r) for r in df.select("repo", "name", "email", "hash", "ts").collect())
    assert pick(first) == pick(again) == pick(S.cleaned(raw.withColumn("repo", F.lower("repo"))))
    assert len(S.cache_key()) == 8 and S.cache_key("") == "811c9dc5"
    (tmp_path / "bad.csv").write_text("repo,name,email,hash\n")
    with pytest.raises(ValueError):
        S.read_cache(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "rows.csv").write_text("time,repo,name,email,hash\n2020-01-01T00:00:00Z,r,N,e@x.com,H\n2020-01-01,r,N,e@x.com,H\n2020-01-01T00:00:00Z,,N,e@x.com,H\n")
    assert [r.hash for r in S.read_cache(spark, str(tmp_path / "rows.csv")).collect()] == ["h"]
    (tmp_path / "wide.csv").write_text("repo,name,email,hash,time\nr,N,e@x.com,H,2020-01-01T00:00:00Z\nr,N,e@x.com,H,2020-01-01T00:00:00Z,more\n")
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_cache(spark, str(tmp_path / "wide.csv")).collect()


def test_other_sinks_and_sources(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    target = sinks.parquet_to_csv(spark, str(tmp_path / "t.parquet"))
    assert target.endswith("t.csv") and spark.read.option("header", True).csv(target).count() == 3
    with pytest.raises(Exception, match="already exists"):
        sinks.parquet_to_csv(spark, str(tmp_path / "t.parquet"))
    sinks.parquet_to_csv(spark, str(tmp_path / "t.parquet"), overwrite=True)
    assert sinks.output_paths("a/b.parquet") == ("a/b-aliases.parquet", "a/b-identities.parquet") == sinks.output_paths("a/b")
    df = people(spark, [(1, "b", "", "z@x.com"), (2, "a", "", "y@x.com")])
    labels = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    sinks.write_text(merge.merged(df, labels), str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["a|b||y@x.com|z@x.com"]
    (tmp_path / "research.csv").write_text("author.email,author.name,author_id,repository,committer.email,committer.name\nA@x.com,Al,1,R,C@x.com,Cy\nB@x.com,,2,R,D@x.com,Di\n")
    assert S.read_research(spark, str(tmp_path / "research.csv")).count() == 1
    assert S.read_research(spark, str(tmp_path / "research.csv"), use_committer=True).count() == 3
    cache = str(tmp_path / "m.csv")
    answers = "email string, repo string, hash string, user string, error string"
    sinks.match_cache(spark.createDataFrame([("a", "", "", "u", None), ("b", "r", "h", None, None), ("c", "", "", None, "down")], answers), cache)
    kept = sinks.read_match_cache(spark, cache)
    sinks.match_cache(spark.createDataFrame([("d", "", "", "v", None)], answers), cache)
    first = [("a", "", "", "u"), ("b", "r", "h", None)]
    assert sorted(tuple(r) for r in kept.collect()) == first
    assert sorted(tuple(r) for r in sinks.read_match_cache(spark, cache).collect()) == [*first, ("d", "", "", "v")]


def test_lookup_by_commit_and_errors(spark):
    """Every person is asked about by the own commit; an address that fails for one of them still links by address."""
    rows = [(1, "al", "", "a@x.com", "h1", "r1"), (2, "al", "", "a@x.com", "h2", "r2"), (3, "bo", "", "b@x.com", "h3", "r3"), (4, "bo", "", "a@x.com", "h1", "r1")]
    df = spark.createDataFrame(rows, PEOPLE)

    class Commits:
        supports_commits = True

        def by_commit(self, email, repo, commit):
            if commit == "h3":
                raise OSError("service is down")
            return {"h1": "A"}.get(commit)

        def on_idle(self):
            pass

    found = external.lookup(df, Commits)
    assert sorted((r.email, r.repo, r.hash, r.user, r.error) for r in found.collect()) == [("a@x.com", "r1", "h1", "A", None), ("a@x.com", "r2", "h2", None, None), ("b@x.com", "r3", "h3", None, "OSError: service is down")]
    assert {r.id: r.external_id for r in external.with_accounts(df, found).collect()} == {1: "A", 2: "", 3: "", 4: "A"}
    assert {r.email for r in external.unmatched(df, found).collect()} == {"a@x.com", "b@x.com"}


def test_command_line(spark, tmp_path, capsys):
    from kinfold import cli

    commits(spark).write.parquet(str(tmp_path / "commits"))
    args = cli.parse(["--output", str(tmp_path / "o.parquet"), "--commits", str(tmp_path / "commits"), "--cache", str(tmp_path / "cache.csv"), "--min-count", "1"])
    a, i = cli.run(spark, args, datetime(2020, 6, 1))
    assert spark.read.parquet(i).count() == 2 and '"people found"' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.parse(["--output", "x", "--commits", "c", "--external", "nobody"])


def test_database_to_database(spark, tmp_path, capsys):
    """The run reads a database, in parts, and loads both tables into one; Spark brings a small database along."""
    from kinfold import cli

    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = commits(spark, [*COMMITS, ("", "Nobody", "n@google.com", "ff", datetime(2020, 1, 1)), ("s'", "Cy", "cy@google.com", "gg", datetime(2020, 1, 1))])
    wide = ", ".join(f"{c} VARCHAR(200)" for c in ("REPOSITORY_ID", "COMMIT_AUTHOR_NAME", "COMMIT_AUTHOR_EMAIL", "COMMIT_HASH"))
    stored = rows.drop("id", "name", "row_ix")
    stored.toDF(*[c.upper() for c in stored.columns]).write.option("createTableColumnTypes", wide).jdbc(url, "commits")
    pick = lambda df: sorted(tuple(r) for r in df.select("repo", "name", "email", "hash", "ts").collect())
    want = pick(S.group_commits(rows))
    assert pick(S.from_jdbc(spark, url)) == want
    parts = S.from_jdbc(spark, url, bounds=["s'", "repo2"])
    assert pick(parts) == want and sorted(r.row_ix for r in parts.collect()) == list(range(1, len(want) + 1))
    args = cli.parse(["--output", str(tmp_path / "o"), "--url", url, "--user", "APP", "--load-user", "APP", "--bounds", "repo2", "--min-count", "1", "--load-url", url, "--load-aliases", "al", "--load-identities", "idn"])
    a, i = cli.run(spark, args, datetime(2020, 6, 1))
    for path, name in ((a, "al"), (i, "idn")):
        stored, loaded = spark.read.parquet(path), spark.read.jdbc(url, name)
        assert sorted(map(tuple, loaded.select(*stored.columns).collect())) == sorted(map(tuple, stored.collect())) != []
        assert sorted(r[0] for r in loaded.select("index").collect()) == list(range(stored.count()))
    with pytest.raises(Exception, match="exists"):
        sinks.to_database(spark.range(1), url, "idn")


def by_definition(rows, matched, lists_popular, limit):
    """Edges one after another as the definition has them, with components walked anew each time: (id, key, mail, external)."""
    near, external = {i: set() for i, *_ in rows}, {i: x for i, _, _, x in rows}

    def side(i):
        seen, stack = {i}, [i]
        while stack:
            for j in near[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        return seen

    def size(i):
        own = side(i)
        return len({m for j, _, m, _ in rows if j in own}) + len({k for j, k, _, _ in rows if j in own})

    def edge(a, b):
        known = external[a] or external[b]
        if external[a] and external[b] and external[a] != external[b]:
            return False
        near[a].add(b)
        near[b].add(a)
        for j in side(a):
            external[j] = known
        return True

    first = {}
    for i, _, _, x in rows:
        if x and first.setdefault(("x", x), i) != i:
            edge(first["x", x], i)
    for i, _, m, _ in rows:
        if m not in matched and first.setdefault(("m", m), i) != i:
            edge(first["m", m], i)
    buckets = {}
    for i, k, _, _ in rows:
        if k not in lists_popular:
            own = buckets.setdefault(k, {})
            anchor = own.setdefault(external[i], i)
            if anchor != i and size(i) < limit and size(anchor) < limit:
                edge(anchor, i)
    for k in sorted(buckets):
        if len(buckets[k]) == 2 and "" in buckets[k]:
            a, b = buckets[k].values()
            if size(a) < limit and size(b) < limit:
                edge(a, b)
    return {i: min(side(i)) for i, *_ in rows}


@pytest.mark.parametrize("seed", range(2))
def test_accounts_and_limit_by_definition(spark, seed):
    rnd = random.Random(seed)
    known = {f"e{k}@x.com": f"U{k % 4}" for k in range(0, 18, 3)}
    rows = [(i, f"n{rnd.randrange(9)}", "", f"e{rnd.randrange(18)}@x.com") for i in range(1, 46)]
    df = people(spark, rows).repartition(4)
    matches = spark.createDataFrame(list(known.items()), "email string, user string")
    with_ids = external.with_accounts(df, matches)
    for limit in (4, 100):
        got = {r.id: r.component for r in L.limited_components(with_ids, LISTS, limit, external.unmatched(df, matches)).collect()}
        assert got == by_definition([(i, n, e, known.get(e, "")) for i, n, _, e in rows], known, {"bob"}, limit), limit


def test_two_runs_share_the_answers_of_a_matcher(spark, tmp_path, capsys):
    from kinfold import cli

    asked = tmp_path / "asked.txt"
    commits(spark).write.parquet(str(tmp_path / "commits"))

    class Counting:
        supports_commits = False

        def by_email(self, email):
            with asked.open("a") as f:
                f.write(email + "\n")
            if email.startswith("alice"):
                return "Alice"
            raise TimeoutError(email)

    cli.MATCHERS["counting"] = lambda api_url, token: Counting()
    try:
        for out in ("one", "two"):
            args = cli.parse(["--output", str(tmp_path / out), "--commits", str(tmp_path / "commits"), "--external", "counting", "--external-cache", str(tmp_path / "m.csv"), "--min-count", "1", "--lists", ""])
            _, i = cli.run(spark, args, datetime(2020, 6, 1))
            assert {r.external_id for r in spark.read.parquet(i).collect()} == {"Alice", ""}
            assert '"graph edges"' in capsys.readouterr().out
    finally:
        del cli.MATCHERS["counting"]
    # each address once a run; the one with an answer is not asked again, the one that failed is
    assert sorted(asked.read_text().split()) == ["alice@google.com", "bob@google.com", "bob@google.com"]
    assert sorted((r.email, r.user) for r in sinks.read_match_cache(spark, str(tmp_path / "m.csv")).collect()) == [("alice@google.com", "Alice")]


def test_metrics_object():
    from kinfold.operators.metrics import Metrics

    m = Metrics()
    m.set("a", 1.5)
    assert m.increment("n") == 1 and m.increment("n") == 2 and m.get("missing") is None
    assert m.to_json() == '{"a": 1.5, "n": 2}'
    with pytest.raises(ValueError):
        m.set("x", float("nan"))
    m.reset()
    assert m.values == {}


def test_stream_counts_equal_batch(spark, tmp_path):
    from kinfold.streaming import frequencies as stream

    rows = commits(spark).drop("id", "name").withColumn("loaded_at", F.col("commit_author_when")).select(*stream.COMMITS.names)
    rows.write.parquet(str(tmp_path / "in"))
    counts = stream.windowed_counts(stream.commit_stream(spark, str(tmp_path / "in")), "commit_author_name")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = stream.windowed_counts(rows, "commit_author_name")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
