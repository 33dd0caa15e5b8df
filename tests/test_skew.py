import random

import pytest

from kinfold.operators.skew import lookup_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_join_as_others_do(spark, how):
    rnd = random.Random(3)
    rows = [(i, 7 if rnd.random() < 0.6 else rnd.randrange(40), 1) for i in range(500)] + [(900, None, 1), (901, 99, 1)]
    df = spark.createDataFrame(rows, "i int, k int, m int")
    lookup = spark.createDataFrame([(k, k * k) for k in range(30)], "k int, v int")
    want = sorted(map(str, df.join(lookup, "k", how).collect()))
    assert sorted(map(str, lookup_join(df, lookup, "k", how, 10, 5).collect())) == want
    assert sorted(map(str, lookup_join(df, lookup, "k", how).collect())) == want
    two = lookup.selectExpr("k", "1 as m", "v")
    assert sorted(r.v or -1 for r in lookup_join(df, two, ["k", "m"], how, 10, 5).collect()) == sorted(r.v or -1 for r in df.join(two, ["k", "m"], how).collect())
    assert lookup_join(df.limit(0), lookup, "k", how).collect() == []


def test_hot_keys_are_broadcast(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 as k")
    plan = lookup_join(df, spark.range(3).selectExpr("id as k", "id as v"), "k", hot_parts=5, hot_rows=1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
