"""Classes of similar sets by prefix filter, without all pairs of a group.

Two sets at a Jaccard coefficient of t share one of their rarest elements, as many as a partner may lack and one more, so sets meet on those.
Where many meet, each is first held against the one with the fewest elements of its own; members that are in different classes
by then meet again, in cells of the lengths that they and a partner may have.  Pairs that another method has found can be given: they are verified first, and what
they put in one class isn't compared again.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, release, stored

#: The elements are counted in so many turns, each over the hashes of one remainder, so that few of them are on disk at a time;
#: whole sets are moved in as many.
TURNS = 4
#: An element in so many sets of every eighth, or in a thousandth of them, is common: it comes last in the order, without a count and
#: without a row of its own.  There are at most a thousand for each element of a mean set, which bounds the list that tasks get.
COMMON = 32
#: Classes of length to a factor of the similarity: more of them make more rows of a member and fewer pairs in vain.
STEPS = 4


def near(index: DataFrame, sets: DataFrame, similarity: float, given: DataFrame | None = None) -> DataFrame:
    """Components ``(node, root)`` of all pairs of ``sets(node, s)`` at a Jaccard coefficient of ``similarity`` or more; ``sets`` is discarded.

    ``index(node, n, own, at, token)`` has the elements on which sets meet; ``given(a, b)``, with ``a > b``, are pairs to verify first.
    """
    meeting, parts = index.select("node").distinct().hint("merge"), []
    for turn in range(TURNS):
        some = sets.where(F.pmod("node", F.lit(TURNS)) == turn)
        parts.append(stored(some.join(meeting, "node", "left_semi").select("node", "s"), "texts-needed"))
        release(sets.sparkSession)
    discard(sets)
    needed = functools.reduce(DataFrame.unionByName, parts)
    member = F.struct("node", "n", "at")
    # The fewer elements of its own, the nearer to the middle of its copies; the same set leads on most elements of a class.
    tops = index.groupBy("token").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "at")).alias("y"), F.count("*").alias("many"))
    tops = stored(tops.where("many > 1"), "texts-tops")

    # Lengths and the elements that remain from here on bound what two sets share, if this is their first common one.
    def bound(a, b):
        least = similarity / (1 + similarity) * (a["n"] + b["n"]) - 1e-9
        return (F.least(a["n"], b["n"]) >= similarity * F.greatest(a["n"], b["n"]) - 1e-9) & (F.least(a["n"] - a["at"], b["n"] - b["at"]) >= least)

    def ordered(pairs):
        return pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()

    def verified(pairs, name):
        both = pairs.join(needed.select(F.col("node").alias("a"), F.col("s").alias("sa")).hint("merge"), "a")
        both = both.join(needed.select(F.col("node").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        found = stored(both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared) - 1e-9).select("a", "b"), name)
        release(needed.sparkSession)
        return found

    links, compared = [], []
    if given is not None:
        links.append(verified(given, "texts-given-links"))
        compared.append(given)
    star = index.select("token", member.alias("x")).join(tops.select("token", "y").hint("merge"), "token").where("x.node <> y.node").where(bound(F.col("x"), F.col("y")))
    pairs = ordered(star)
    if given is not None:
        tree = components(links[0])
        release(sets.sparkSession)
        of = lambda x: tree.select(F.col("node").alias(x), F.col("root").alias(f"{x}c"))
        apart = pairs.join(given.hint("merge"), ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        pairs = apart.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")
    compared.append(stored(pairs, "texts-pairs"))
    links.append(verified(compared[-1], "texts-links"))
    # Of two members on a element both have been compared.  Of more, those of different classes are, where lengths and places let them.
    tree = components(functools.reduce(DataFrame.union, links))
    release(sets.sparkSession)
    classed = index.join(tree, "node", "left").withColumn("c", F.coalesce("root", "node"))
    open_ = classed.groupBy("token").agg(F.count("*").alias("many"), F.min("c").alias("low"), F.max("c").alias("high")).where("many > 2 and low < high")
    open_ = classed.select("token", F.struct("node", "n", "at", "c").alias("x")).join(open_.select("token").hint("merge"), "token")
    open_ = stored(open_, "texts-open")
    longer, shorter = cells(open_, similarity)
    meet = longer.select("token", "long", "short", F.col("x.c").alias("cx")).distinct().join(shorter.select("token", "long", "short", F.col("y.c").alias("cy")).distinct(), ["token", "long", "short"]).where("cx <> cy")
    cross = meet.join(longer.withColumn("cx", F.col("x.c")), ["token", "long", "short", "cx"]).join(shorter.withColumn("cy", F.col("y.c")), ["token", "long", "short", "cy"]).where(bound(F.col("x"), F.col("y")))
    rest = stored(ordered(cross).join(functools.reduce(DataFrame.union, compared).hint("merge"), ["a", "b"], "left_anti"), "texts-rest")
    links.append(verified(rest, "texts-more-links"))
    tree = components(functools.reduce(DataFrame.union, links))
    discard(*parts, tops, *compared, open_, rest, *links)
    return tree


def cells(members: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(token, long, short, x)`` and ``(token, long, short, y)`` of ``members(token, x)``: in the role of the longer set of a pair and of the shorter.

    Lengths fall into classes, ``STEPS`` to a factor of the similarity.  A member's length and place bound the length of a partner: it
    goes to the cells of its own class and each of these.  So two that may be similar share a cell, and lengths or places that rule a pair
    out keep most such members apart before any pair is made.
    """
    width = max(-math.log(similarity), 0.01) / STEPS
    of = lambda n: F.floor(F.log(n) / width).cast("int")
    n, most = F.col("x.n"), (1 + similarity) / similarity * (F.col("x.n") - F.col("x.at")) - F.col("x.n") + 1e-6
    low, high = of(similarity * n - 1e-6), of(F.greatest(F.lit(1e-6), F.least(n + 1e-6, most)))
    longer = members.where(most >= similarity * n - 1e-6).select("token", of(n).alias("long"), F.explode(F.sequence(low, F.greatest(low, high))).alias("short"), "x")
    high = of(F.least(n / similarity + 1e-6, most))
    shorter = members.where(most >= n).select("token", F.explode(F.sequence(of(n), F.greatest(of(n), high))).alias("long"), of(n).alias("short"), F.col("x").alias("y"))
    return longer, shorter


def rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """``(node, n, own, at, token)``: of ``sets(node, s)`` the first ``n - ceil(similarity * n) + 1`` elements in the order of how many
    sets have them, without the ``own`` ones that no other set has; ``at`` is the place in that order, from 0."""
    spark = sets.sparkSession
    eighth = sets.where(F.pmod(F.xxhash64("node"), F.lit(8)) == 0)
    often = F.greatest(F.lit(COMMON), F.lit(eighth.count() / 1000))
    common = eighth.select(F.explode("s").alias("token")).groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") >= often)
    common = stored(common.select("token"), "texts-common")
    held = spark.sparkContext.broadcast(np.sort(np.fromiter((r[0] for r in common.toLocalIterator()), np.int64)))

    def split(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                own = [s.values.to_numpy() for s in c.column(1)]
                # Elements are sorted, and so are the common ones of a set.
                found = [x[held.value[np.searchsorted(held.value, x).clip(max=len(held.value) - 1)] == x] if len(held.value) else x[:0] for x in own]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(map(len, own), pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["node", "n", "last"])

    last = stored(sets.select("node", "s").mapInArrow(split, "node bigint, n int, last array<bigint>"), "texts-last")
    parts = []
    for turn in range(TURNS):
        tokens = sets.select("node", F.explode(F.filter("s", lambda x: F.pmod(x, F.lit(TURNS)) == turn)).alias("token"))  # noqa: B023
        rare = tokens.join(F.broadcast(common), "token", "left_anti")
        counted = rare.select("node", "token", F.count("*").over(Window.partitionBy("token")).alias("often")).where("often > 1")
        parts.append(stored(counted, "texts-shared"))
        release(spark)
    by = functools.reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("by"))
    of = last.join(by.hint("merge"), "node", "left").select("node", "n", F.concat(F.coalesce(F.col("by.token"), F.array().cast("array<bigint>")), "last").alias("by"))
    own = F.col("n") - F.size("by")
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    cut = of.where(prefix > own).select("node", "n", own.alias("own"), F.posexplode(F.slice("by", F.lit(1), (prefix - own).cast("int"))).alias("k", "token"))
    index = stored(cut.select("node", "n", "own", (F.col("own") + F.col("k")).alias("at"), "token"), "texts-index")
    held.unpersist()
    discard(common, last, *parts)
    release(spark)
    return index
