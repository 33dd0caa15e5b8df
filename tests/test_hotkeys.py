from datetime import datetime

from kinfold.operators.hotkeys import hot_keys, key_statistics

SCHEMA = "row_ix long, repository_id string, commit_author_name string, commit_author_email string, commit_author_when timestamp, field string, key string, n_rows string, __n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "x", "x", "x") for i, r in enumerate(rows)], SCHEMA)


def test_statistics_with_nulls_ties_and_clashing_columns(spark):
    a, b = datetime(2020, 1, 1), datetime(2020, 2, 1)
    rows = [("r1", "n", "e", a), ("r1", "n", "e", a), ("r2", "n", None, b), (None, "n", "", None), ("r1", None, "e", b)]
    got = {(r.field, r.key): (r.n_rows, r.n_repositories, r.first_when, r.last_when) for r in key_statistics(frame(spark, rows)).collect()}
    assert got == {
        ("commit_author_name", "n"): (4, 2, a, b), ("commit_author_email", "e"): (3, 1, a, b), ("commit_author_email", ""): (1, 0, None, None),
    }


def test_hot_keys_at_the_bound(spark):
    rows = [("r", "hot", f"e{i}", None) for i in range(7)] + [("r", f"n{i}", None, None) for i in range(693)]
    assert [(r.field, r.key) for r in hot_keys(frame(spark, rows), 0.01).collect()] == [("commit_author_name", "hot")]


def test_empty(spark):
    df = frame(spark, [])
    assert key_statistics(df).collect() == [] and hot_keys(df).collect() == []


def test_hot_key_does_not_reach_a_reducer_as_rows(spark):
    """The plan aggregates before every exchange."""
    text = key_statistics(frame(spark, [("r", "n", "e", None)]))._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") >= 4 and "partial_" in text
