"""Crawl budgets, steps that fail, levels of steps, tenants in SQL, and runs that fall silent."""

import random
import time
from collections import deque

import pytest
from pyspark.sql import functions as F

from docloom.operators.graph import crawl
from docloom.operators.sql import SqlError, run_sql
from docloom.streaming import events, lifecycle
from docloom.workflow import run as workflow


def queued(links, roots, max_depth, max_pages):
    """A plain queue."""
    seen, items, queue = set(), [], deque()
    for r in roots:
        if r not in seen:
            seen.add(r)
            queue.append((r, 0, None))
    while queue and len(items) < max_pages:
        node, depth, parent = queue.popleft()
        items.append((node, depth, parent, len(items)))
        if depth < max_depth:
            for dst in links.get(node, []):
                if dst is not None and dst not in seen:
                    seen.add(dst)
                    queue.append((dst, depth + 1, node))
    return items


@pytest.mark.parametrize("max_pages, max_depth", [(0, 3), (7, 3), (40, 4), (1000, 2)])
def test_crawl(spark, tmp_path, max_pages, max_depth):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rnd = random.Random(max_pages)
    links = {f"p{i}": [rnd.choice([None, "p0", f"p{rnd.randrange(90)}"]) for _ in range(rnd.randrange(6))] for i in range(80)}
    roots = ["p3", "p1", "p3", "lonely"]
    edges = spark.createDataFrame([(s, k, d) for s, out in links.items() for k, d in enumerate(out)], "src string, place int, dst string").repartition(3)
    start = spark.createDataFrame([(r, k) for k, r in enumerate(roots)], "node string, place int")
    got = sorted(map(tuple, crawl(edges, start, max_depth, max_pages).collect()), key=lambda r: r[3])
    assert got == queued(links, roots, max_depth, max_pages)


STEPS = """
[steps.bad]
type = "sql"
continue_on_error = %s
config = { query = "SELECT raise_error('no') AS x FROM t" }
[steps.good]
type = "sql"
config = { query = "SELECT id AS x FROM t" }
[steps.both]
type = "function"
function = "all"
depends_on = ["bad", "good"]
"""


@pytest.mark.parametrize("folder", [True, False])
def test_a_step_that_fails_while_it_runs(spark, tmp_path, folder):
    spark.sparkContext.setCheckpointDir(str(tmp_path / "checkpoints"))
    t = spark.createDataFrame([(1,), (2,)], "id int")
    call = lambda may: workflow.run(spark, workflow.parse(STEPS % may), {}, {"t": t}, {"all": lambda df, c: df.select("x")}, f"file://{tmp_path}" if folder else None)
    out = call("true")
    assert set(out) == {"good", "both"} and sorted(r.x for r in out["both"].collect()) == [1, 2]
    with pytest.raises(Exception, match="no"):
        call("false")["both"].collect()


def steps(**depends):
    return {n: workflow.Step(n, "sql", list(d), {"priority": p} if p is not None else {}) for n, (d, p) in depends.items()}


def test_levels_and_critical_path():
    diamond = steps(end=("bc", None), c=("a", 5), b=("a", None), a=("", None))
    assert workflow.levels(diamond) == [["a"], ["c", "b"], ["end"]] and workflow.critical_path(diamond) == ["a", "c", "end"]
    ties = steps(z=("", None), y=("", None), x=("yz", None), solo=("", 1))
    assert workflow.levels(ties) == [["solo", "y", "z"], ["x"]] and workflow.critical_path(ties) == ["y", "x"]
    longer = steps(a=("", None), b=("a", None), c=("b", 200), d=("a", 1), e=("", 1))
    assert workflow.critical_path(longer) == ["a", "b", "c"] and workflow.levels({}) == [] and workflow.critical_path({}) == []
    assert workflow.parse("".join(f'[steps.{n}]\ntype = "sql"\nconfig = {{ priority = {p} }}\n' for n, p in (("a", 3), ("b", 2)))).order == ["b", "a"]


def test_tenants_in_sql(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "id int, tenant string")
    u = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (3, "b", "z")], "id int, tenant string, v string")
    tables = {"t": t, "u": u, "names": spark.createDataFrame([(1, "one")], "id int, name string")}
    text = "SELECT t.id, v, (SELECT count(*) FROM u) AS n FROM t LEFT JOIN u ON t.id = u.id WHERE t.id IN (SELECT id FROM t UNION ALL SELECT id FROM u)"
    ask = lambda q, who="a", **more: sorted(map(tuple, run_sql(spark, q, {}, tables, tenant=("tenant", who), shared=("names",), **more).collect()))
    assert ask(text) == [(1, "x", 1), (3, None, 1)] and ask(text, "b") == [(2, None, 2)] and ask(text, None) == []
    assert ask("SELECT name FROM names JOIN t USING (id)") == [("one",)]
    spark.range(3).createOrReplaceTempView("elsewhere")
    for bad in ("SELECT * FROM elsewhere", "SELECT * FROM t, elsewhere", "SELECT * FROM default.t", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM t JOIN parquet.`/tmp/x` p"):
        with pytest.raises(SqlError) as e:
            ask(bad)
        assert e.value.kind == "tenant_error"
    with pytest.raises(SqlError):
        run_sql(spark, "SELECT * FROM names", {}, tables, tenant=("tenant", "a"))
    spark.catalog.dropTempView("elsewhere")


def test_a_silent_run_fails(spark, tmp_path):
    folder, schema = str(tmp_path / "events"), "id bigint, run_id string, status string"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    put((1, "r1", "running"), (2, "r2", "running"), (3, "r2", "completed"), (4, "r3", "completed"), (5, "r3", None))
    lifecycle.with_timers(spark)
    live = lifecycle.live_runs(events.stream(spark, folder, schema), stale_minutes=0.2)
    query = live.writeStream.outputMode("update").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60  # with timers there always is a next batch, so the query is never done

        def seen(condition):
            while time.time() < until and not spark.sql(f"SELECT 1 FROM live WHERE {condition}").take(1):
                time.sleep(0.5)

        seen("status = 'completed'")
        put((6, "r2", "running"), (1, "r1", "completed"))
        seen("stale")
        rows = sorted(tuple(r) for r in spark.table("live").collect())
    finally:
        query.stop()
        spark.conf.unset(lifecycle.STORE[0])
    assert rows == [("r1", "failed", 1, True), ("r1", "running", 1, False), ("r2", "completed", 3, False)]
