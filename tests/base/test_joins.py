"""Joins on time and ranges against plain loops, with hot keys, ties and nulls."""

import random
from datetime import datetime, timedelta

import pytest

from docloom.operators import joins

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("bucket", ["1 hour", "1000 days"])
def test_as_of(spark, bucket):
    rnd = random.Random(1)
    at = lambda: T0 + timedelta(minutes=rnd.randrange(600)) if rnd.random() > 0.05 else None
    key = lambda: rnd.choice(["hot"] * 8 + ["a", "b", None])
    left, right = [(i, key(), at()) for i in range(300)], [(key(), at(), rnd.randrange(50)) for _ in range(200)]
    a = spark.createDataFrame(left, "id int, k string, t timestamp").repartition(3)
    b = spark.createDataFrame(right, "rk string, rt timestamp, v int").repartition(3)
    got = joins.as_of(a, b, {"k": "rk"}, ("t", "rt"), bucket)
    expected = []
    for i, k, t in left:
        found = max(((rt, v) for rk, rt, v in right if rk == k and k is not None and rt is not None and t is not None and rt <= t), default=(None, None))
        expected.append((i, k, t, k if found[0] else None, *found))
    assert got.columns == ["id", "k", "t", "rk", "rt", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def test_as_of_empty_sides(spark):
    a, b = spark.createDataFrame([(1, "k", T0)], "id int, k string, t timestamp"), spark.createDataFrame([], "rk string, rt timestamp, v int")
    assert [tuple(r) for r in joins.as_of(a, b, {"k": "rk"}, ("t", "rt")).collect()] == [(1, "k", T0, None, None, None)]
    assert joins.as_of(a.where("id > 1"), b, {"k": "rk"}, ("t", "rt")).collect() == []


@pytest.mark.parametrize("width", [0.5, 7, 1000])
def test_ranges_and_spans(spark, width):
    rnd = random.Random(2)
    points = [(i, rnd.choice([None, 5.0, rnd.uniform(-40, 40)])) for i in range(120)]
    spans = [(i, rnd.choice("xy"), lo, lo + rnd.choice([0.0, 0.25, 6.0, 30.0])) for i in range(60) for lo in [rnd.choice([5.0, -5.0, rnd.uniform(-40, 40)])]] + [(99, "x", None, 1.0)]
    p = spark.createDataFrame(points, "pid int, x double")
    a = spark.createDataFrame(spans, "a int, ka string, a0 double, a1 double")
    b = spark.createDataFrame(spans, "b int, kb string, b0 double, b1 double")
    got = joins.within(p, a, "x", "a0", "a1", width)
    assert sorted((r["pid"], r["a"]) for r in got.collect()) == sorted((i, j) for i, x in points for j, _, lo, hi in spans if None not in (x, lo) and lo <= x < hi)
    for on in ({"ka": "kb"}, {}):
        both = joins.overlapping(a, b, on, ("a0", "a1", "b0", "b1"), width)
        expected = [(i, j) for i, k, lo, hi in spans for j, m, lo2, hi2 in spans if None not in (lo, lo2) and lo < hi and lo2 < hi2 and lo < hi2 and lo2 < hi and (k == m or not on)]
        assert sorted((r["a"], r["b"]) for r in both.collect()) == sorted(expected)
        for df in (got, both):
            plan = df._jdf.queryExecution().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
