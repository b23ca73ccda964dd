"""Joins whose pairs are only counted: totals against plain loops, and no join that makes the pairs."""

import random

import duckdb
import pytest

from docloom.operators import joins
from docloom.plans import catalog, joined  # noqa: F401


def joined_rows(df):
    """The rows of ``df`` and the most rows that a join of its plan made."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return rows, most


@pytest.mark.parametrize("width", [0.5, 7, 1000])
def test_totals_of_ranges(spark, width):
    rnd = random.Random(3)
    points = [(i if rnd.random() < 0.9 else None, rnd.choice([None, 5.0, 7.0, 0.0, -0.0, float("nan"), float("inf"), rnd.uniform(-40, 40)])) for i in range(200)] + [(None, 900.0)]
    spans = [(i % 50, lo, lo + rnd.choice([0.0, 2.0, 6.0, 30.0])) for i in range(60) for lo in [rnd.choice([5.0, -5.0, 0.0, rnd.uniform(-40, 40)])]]
    spans += [(98, None, 1.0), (99, 1.0, None), (97, 899.0, 901.0), (96, 3.0, -3.0), (95, float("-inf"), float("inf")), (94, 4.0, float("nan"))]
    p, r = spark.createDataFrame(points, "v bigint, x double"), spark.createDataFrame(spans, "a int, a0 double, a1 double")
    expected = []
    for a, lo, hi in spans:
        if None not in (lo, hi) and not hi <= lo:
            inside = [v for v, x in points if x is not None and x == x and lo <= x and (x < hi or hi != hi)]
            known = [v for v in inside if v is not None]
            expected += [(a, str(lo), str(hi), len(inside), sum(known) if known else None)] if inside else []
    got = joins.within_totals(p.repartition(3), r.repartition(2), "x", "a0", "a1", "v", width)
    assert got.columns == ["a", "a0", "a1", "n", "total"]
    assert sorted(map(str, ((a, str(lo), str(hi), n, t if t is None else int(t)) for a, lo, hi, n, t in got.collect()))) == sorted(map(str, expected))


@pytest.mark.parametrize("name", ["join_range_binned", "sql_joins"])
def test_pairs_are_counted_and_not_made(spark, tmp_path, name):
    """800 customers and 600 suppliers in one place: 480,000 pairs."""
    con = duckdb.connect()
    con.sql("CREATE TABLE customer AS SELECT i AS c_custkey, 'c' AS c_name, CASE WHEN i % 100 > 0 THEN 3 END::INT AS c_nationkey, (i % 7)::DOUBLE AS c_acctbal FROM range(800) t(i)")
    con.sql("CREATE TABLE supplier AS SELECT i // 2 AS s_suppkey, 's' AS s_name, CASE WHEN i < 590 THEN 3 WHEN i < 595 THEN 77 END::INT AS s_nationkey, (i % 3 - 1)::DOUBLE AS s_acctbal FROM range(600) t(i)")
    con.sql("CREATE TABLE nation AS SELECT i::INT AS n_nationkey, CASE WHEN i <> 5 THEN 'n' || i % 4 END AS n_name, 1 AS n_regionkey FROM range(8) t(i)")
    for t in ("customer", "supplier", "nation"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    rows, most = joined_rows(df)
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, con.sql(catalog.ORACLE_SQL[name]).fetchall()))
    assert 0 < most <= 1400
