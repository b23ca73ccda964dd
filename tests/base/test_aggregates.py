"""Aggregates whose states merge, table functions as steps, and sketches of days against exact values."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.operators import analytics
from docloom.operators.aggregates import Aggregate, by_table_function, grouped
from docloom.plans.extended import Sessions, longest
from docloom.workflow import run as workflow

SPREAD = Aggregate(
    "low bigint, high bigint, seen array<bigint>",
    "spread bigint, distinct int",
    lambda t: (v := [x for x in t["v"].to_pylist() if x is not None]) is None or {"low": min(v, default=None), "high": max(v, default=None), "seen": sorted(set(v))},
    lambda ss: {"low": min((s["low"] for s in ss if s["seen"]), default=None), "high": max((s["high"] for s in ss if s["seen"]), default=None), "seen": sorted({x for s in ss for x in s["seen"]})},
    lambda s: {"spread": s["high"] - s["low"] if s["seen"] else None, "distinct": len(s["seen"])},
)


@pytest.mark.parametrize("most, fan_in", [(1, 1), (3, 2), (50_000, 256)])
def test_grouped(spark, most, fan_in):
    rnd = random.Random(most)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None, ""]), rnd.choice([None, 1 << 60, 7]), rnd.choice([None, rnd.randrange(40)])) for _ in range(600)] + [("none", 1, None)]
    want = defaultdict(list)
    for a, b, v in rows:
        want[a, b].append(v)
    want = {k: (max(v) - min(v) if v else None, len(set(v))) for k, v in ((k, [x for x in vs if x is not None]) for k, vs in want.items())}
    got = grouped(spark.createDataFrame(rows, "a string, b bigint, v bigint").repartition(5), ["a", "b"], SPREAD, most, fan_in).collect()
    assert {(r["a"], r["b"]): (r["spread"], r["distinct"]) for r in got} == want and len(got) == len(want)


def test_only_states_are_shuffled(spark):
    df = grouped(spark.range(10).selectExpr("id % 2 AS a", "id AS v", "repeat('x', 100) AS text").select("a", "v"), ["a"], SPREAD)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") > plan.rindex("Exchange")


def test_grouped_of_nothing(spark):
    assert grouped(spark.createDataFrame([], "source string, doc_id bigint, n_chars bigint"), ["source"], longest(2)).collect() == []


def test_sessions_of_events(spark):
    at = lambda h, m=0: f"2024-01-01 {h:02}:{m:02}:00"
    rows = [(1, at(1)), (1, at(3)), (1, at(1, 30)), (2, at(0)), (None, at(5)), (None, at(5))]
    df = spark.createDataFrame(rows, "user_id bigint, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = by_table_function(df, Sessions, ["user_id"], ["ts"], {"minutes": 30}).collect()
    assert sorted([(r["user_id"], r["session"], r["events"]) for r in got], key=str) == sorted([(1, 1, 2), (1, 2, 1), (2, 1, 1), (None, 1, 2)], key=str)
    descending = by_table_function(df.where("user_id = 1"), Sessions, ["user_id"], ["-ts"], {"minutes": 30}).collect()
    assert [r["started"] > r["ended"] for r in descending if r["events"] > 1] == [True]
    with pytest.raises(ValueError, match="order"):
        by_table_function(df, Sessions, (), ["ts"])


def test_steps_of_both_kinds(spark):
    @F.udtf(returnType="word string, n int")
    class Words:
        def eval(self, row, least):
            for w in (row["text"] or "").split():
                if len(w) >= least:
                    yield w, len(w)

    total = Aggregate("n bigint", "n_total bigint", lambda t: {"n": sum(t["n"].to_pylist())}, lambda ss: {"n": sum(s["n"] for s in ss)}, lambda s: {"n_total": s["n"]})
    text = """
[steps.t]
type = "table"
config = { name = "t" }
[steps.words]
type = "table-function"
depends_on = ["t"]
function = "words"
config = { params = { least = 2 } }
[steps.totals]
type = "aggregate"
depends_on = ["words"]
function = "total"
config = { group_by = "word" }
"""
    t = spark.createDataFrame([("aa b ccc aa",), (None,), ("ccc",)], "text string")
    out = workflow.run(spark, workflow.parse(text), {}, {"t": t}, {"words": Words, "total": total})
    assert sorted(map(tuple, out["totals"].collect())) == [("aa", 4), ("ccc", 6)]


def test_quantiles_from_merged_days(spark):
    rnd = random.Random(5)
    rows = [(k % 2, f"2024-01-{d:02}", None if k % 50 == 0 else rnd.expovariate(0.01) * d) for d in range(1, 9) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, day string, v double").withColumn("day", F.to_date("day")).repartition(7)
    sketches = analytics.quantile_sketches(df, ["a"], "day", "v")
    assert sketches.count() == 16
    got = analytics.quantile_estimates(sketches, ["a"], [0.1, 0.5, 0.99], "2024-01-03", "2024-01-07").collect()
    assert len(got) == 2
    for r in got:
        exact = sorted(v for a, d, v in rows if a == r["a"] and v is not None and "2024-01-03" <= d < "2024-01-07")
        assert r["n"] == len(exact)
        for q, v in zip([0.1, 0.5, 0.99], r["quantiles"]):
            assert abs(sum(x <= v for x in exact) / len(exact) - q) <= 0.02
