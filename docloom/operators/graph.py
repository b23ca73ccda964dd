"""Link graphs: breadth-first reach and crawl rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import path


def reach(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """``(node, depth, parent)`` of every node within ``max_depth`` steps of ``roots(node)``: least depth, then least parent.

    Each round joins the frontier with ``edges(src, dst)`` and drops what was seen.  A round keeps its own nodes, by a reliable checkpoint where the
    session has a folder for it; what was seen is their union, so no node is written twice however deep the graph is.
    """
    spark = edges.sparkSession
    settle = (lambda df: df.checkpoint()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda df: df.persist())
    frontier = settle(roots.select("node").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["src"].dataType).alias("parent")))
    seen = frontier
    for depth in range(1, max_depth + 1):
        step = edges.join(frontier.select(F.col("node").alias("src")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = settle(step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _ranked(rows: DataFrame, order: list[str], start: int, settle) -> tuple[DataFrame, int]:
    """``rows`` with ``rank`` from ``start`` on in the order of columns, and their number; no partition holds all of them.

    Ranges of the order are partitions, each counts its rows, and only the counts come to the driver.
    """
    dealt = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = start + total, total + sizes[p]
    if not total:
        return dealt.select(*rows.columns, F.lit(0).cast("bigint").alias("rank")), 0
    bases = F.create_map(*[F.lit(x).cast("bigint") for pair in before.items() for x in pair])
    return dealt.select(*rows.columns, (bases[part] + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")), total


def crawl(links: DataFrame, roots: DataFrame, max_depth: int, max_pages: int) -> DataFrame:
    """``(node, depth, parent, rank)`` of the first ``max_pages`` pages that a queue visits, ``rank`` from 0 in its order.

    ``links(src, place, dst)`` are the pages' links in their order, ``roots(node, place)`` starts the queue.  A page joins the queue with the
    first link to it that is seen, and pages deeper than ``max_depth`` don't.  Each round ranks one depth's new pages by the rank of the
    page and the place of the link that found them, and cuts them at what is left of the budget, so later rounds follow only pages
    within it.  Rounds keep their own pages; what was seen is their union, never rewritten.  Null nodes and links aren't followed.
    """
    spark = links.sparkSession
    settle = (lambda df: df.checkpoint()) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else (lambda df: df.persist())
    kind = links.schema["src"].dataType
    found = roots.where("node is not null").groupBy("node").agg(F.min("place").alias("place")).select("node", F.lit(None).cast(kind).alias("parent"), F.lit(0).cast("bigint").alias("by"), "place")
    rounds, count = [], 0
    for depth in range(max_depth + 1):
        ranked, new = _ranked(found, ["by", "place", "node"], count, settle)
        ranked = settle(ranked.where(F.col("rank") < max_pages).select("node", F.lit(depth).alias("depth"), "parent", "rank"))
        rounds.append(ranked)
        count += new
        if not new or count >= max_pages or depth == max_depth:
            break
        step = links.where("dst is not null").join(ranked.select(F.col("node").alias("src"), F.col("rank").alias("by")), "src")
        first = step.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("by", "place", "src")).alias("m")).select("node", F.col("m.src").alias("parent"), "m.by", "m.place")
        for seen in rounds:
            first = first.join(seen.select("node"), "node", "left_anti")
        found = first
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def robots_rules(text: Column) -> Column:
    """Disallowed prefixes for all agents, as an array.  Lines are read in order and in lower case."""
    lines = F.transform(F.split(F.lower(text), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    start = F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("found"))

    def step(state, line):
        agent = F.trim(F.regexp_extract(line, "^user-agent:(.*)$", 1))
        rule = F.trim(F.regexp_extract(line, "^disallow:(.*)$", 1))
        on = F.when(line.startswith("user-agent:"), agent.isin("*", "claude")).otherwise(state["on"])
        more = F.when(state["on"] & (rule != ""), F.array_append(state["found"], rule)).otherwise(state["found"])
        return F.struct(on.alias("on"), more.alias("found"))

    return F.array_sort(F.array_distinct(F.aggregate(lines, start, step, lambda s: s["found"])))


def blocked(url: Column, rules: Column) -> Column:
    """Whether a rule is a prefix of the address's path; a trailing ``*`` of a rule means nothing more."""
    own = F.when(path(url) == "", "/").otherwise(path(url))
    return F.exists(rules, lambda r: F.startswith(own, F.regexp_replace(r, r"\*$", "")))
