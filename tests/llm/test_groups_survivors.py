import random
from datetime import datetime

import pytest

from kinfold.llm import groups, survivors
from kinfold.session import written


def plain(pairs):
    top = {x: x for p in pairs for x in p}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {i: root(i) for i in top}


@pytest.mark.parametrize(("per_cell", "hot_rows"), [(10, 1), (60, 10**6), (1 << 18, 10**6)])
def test_grid_against_union_find(spark, per_cell, hot_rows):
    rnd = random.Random(per_cell)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    rnd.shuffle(chain)
    hub = [(5000, i) for i in range(5001, 5080)]
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + chain + hub
    dirty = [*pairs, *[(b, a) for a, b in pairs[:30]], *pairs[:30], (3, 3), (None, 5), (7, None)]
    got = {r.id: r.group_id for r in groups.connected_groups(spark.createDataFrame(dirty, "a long, b long"), per_cell, hot_rows, 20).collect()}
    linked = [p for p in pairs if p[0] != p[1]]
    assert got == plain(linked)


def test_few_edges_still_lie_in_several_cells(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long")
    found = groups._grid_round(edges, 4)
    assert found.rdd.getNumPartitions() == 10
    given = {r.v for r in found.collect()}
    assert given == set(range(51)) and found.count() > 51  # ends in several cells get several representatives


def test_no_edges(spark):
    assert groups.connected_groups(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


PEOPLE = "id long, names array<struct<name string, repo string>>, emails array<string>, key string, popular boolean, src long"


def test_person_groups(spark):
    rows = [
        (1, [("Ann  B", "")], None), (2, [("ann b ", "x"), None, ("", ""), (None, None)], [None, " "]), (3, None, ["A@x ", "shared@m"]), (4, [], ["a@X"]),
        (5, [("Alex", "r")], ["shared@m"]), (6, [("alex", "r")], []), (7, [("ALEX", "q")], []), (8, [("alex", "")], []), (9, [("alex", None)], []), (10, [], []), (11, [], []), (12, [], []),
    ]
    people = spark.createDataFrame([(*r, "k", True, 0) for r in rows] + [(1, None, None, "k", True, 0)], PEOPLE)
    links = spark.createDataFrame([(10, 11, " SAME ", 1), (11, 10, "same", 1), (12, 12, "same", 1), (12, 10, "different", 1), (12, 99, "same", 1), (None, 12, "same", 1), (12, 11, None, 1)], "id_a long, id_b long, verdict string, id long")
    lists = spark.createDataFrame([("popular_names", "alex"), ("popular_emails", "shared@m")], "list_name string, entry string")
    got = {r.id: r.group_id for r in groups.person_groups(people, links, lists).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 10: 10, 11: 10}
    nobody = people.where("id < 0")
    assert groups.person_groups(nobody, links, lists).collect() == []


def test_written_table_survives_without_lineage(spark):
    df = written(spark.range(5), "t")
    assert "Range" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 5


ACCOUNTS = "id long, external_id_provider string, external_id string, primary_name string, primary_email string, record_origin string, updated_at timestamp, trust int, __rank int"


def test_survivors(spark):
    old, new = datetime(2020, 1, 1), datetime(2021, 1, 1)
    rows = [
        (1, "p", "a", "Ann", " None ", "import", new), (2, "p", "a", "(No Name)", "a@x", None, new), (3, "p", "a", "Anne", "b@x", "directory", old), (4, "p", "a", "Annie", None, "directory", old),
        (5, "p", "b", None, "", "directory", new), (6, "p", "b", " ", "nobody@invalid", "directory", new),
        (7, "p", "single", "X", "x@x", "directory", new), (8, None, None, "Y", "y@x", "directory", new), (9, None, None, "Y", "y@x", "directory", new),
        (10, "q", "a", "Q", "q@x", "unheard of", None), (11, "q", "a", "R", "r@x", None, new), (12, "q", "a", "R" * 100_000, "r@x", "import", None),
    ]
    people = spark.createDataFrame([(*r, 9, 1) for r in rows], ACCOUNTS)
    origins = spark.createDataFrame([("directory", 5), ("import", 2), ("import", 1), (None, 9)], "origin string, trust int")
    got = {(r.external_id_provider, r.external_id): (r.name_id, r.email_id) for r in survivors.account_survivors(people, origins).collect()}
    assert got == {("p", "a"): (3, 3), ("p", "b"): (None, None), ("q", "a"): (12, 12)}
    assert survivors.account_survivors(people.where("id < 0"), origins).collect() == []
    assert survivors.account_survivors(people, origins.where("trust > 99")).count() == 3


def test_group_limit_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "g", "x", 3)], "id long, g string, v string, o int")
    plan = survivors.best_row(df, ["g"], ["id"], [df.o.desc(), df.id.asc()])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
