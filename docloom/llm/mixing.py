"""Mixing sources to target weights by Efraimidis-Spirakis sampling with token budgets.

Targets come from weights by filling up: a source takes its weight's share, at most ``most`` times its size, and the
excess goes to the others by weight.  A source's documents get exponential keys, -ln(u) / weight, so the
smallest keys are a weighted sample without replacement.  Complete epochs come first; the rest of the
target takes documents in key order until the prefix sum of sizes reaches it, and the last one in part.

A source may hold a third of all rows, so its order is never made in one task: keys are dealt into buckets of about
``_BUCKET`` documents by a monotone transform, bucket sums are prefix-summed, and rows are sorted within their bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED, WORD, stored

_BUCKET = 2048


def targets(per: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """``per(source, source_size, ...)`` with ``target``; one row for each source.

    Sources in code point order, null last, take the weights in turn.  In order of cap over weight, a source is capped as
    long as its share of what is left, by weight, exceeds the cap; the others divide the remainder by weight.  Targets
    add up to the sum of sizes.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    rest = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    past = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    per = per.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(past), F.lit(0.0)))
    per = per.withColumn("_level", F.col("_left") / F.sum("_w").over(rest))
    open_ = F.col("_cap") > F.col("_level") * F.col("_w")
    level = F.min(F.when(open_, F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(everything)["_level"]
    return per.withColumn("target", F.coalesce(F.least("_cap", level * F.col("_w")), F.col("_cap"))).drop("_w", "_cap", "_left", "_level")


def share_below(key: Column, spread: Column, n: Column) -> Column:
    """The expected share of a source's ``n`` keys below ``key``, for its weights ``spread`` (array of ``_mean`` and ``_m``, how many have it).

    It never falls with the key and is about uniform over the source's rows, whatever the weights are.
    """
    return 1 - F.aggregate(spread, F.lit(0.0), lambda s, x: s + x["_m"] * F.exp(-key * x["_mean"])) / n


def mixed(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, epochs, row, drawn)`` for every row of ``docs(doc_id, source, text)``.

    ``size`` is the number of words, 0 for null; ``taken`` counts the words that the mix takes, with repeats: whole epochs
    of the source, and in key order what the rest of the target holds.  ``quality(doc_id, weight)`` scales the keys; a
    document without a positive finite weight there has weight 1.  The null source is a source; a null id is an ordinary value.
    Ids needn't be unique: the text is part of what a key is drawn from, and equal rows share a key.  Extra columns are
    ignored; an empty table returns no rows.
    """
    rows = docs.select("doc_id", "source", F.xxhash64("source", "text").alias("row"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    if quality is not None:
        one = quality.groupBy("doc_id").agg(F.max("weight").alias("weight"))
        rows = rows.join(one.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")
        rows = rows.withColumn("weight", F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight").cast("double")).otherwise(1.0))
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    drawn = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest"), F.lit(str(seed))))
    u = (F.conv(F.substring(drawn, 1, 13), 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))
    rows = stored(rows.select("doc_id", "source", "row", "size", "weight", (-F.log(u) / F.col("weight")).alias("key")), "mix-rows")

    # Weights of a source in classes of a quarter of an octave, at most some thousand however many documents it has.
    level = F.round(F.log2("weight") * 4).cast("int")
    classes = rows.groupBy("source", level.alias("_level")).agg(F.sum("size").alias("_size"), F.count("*").alias("_m"), F.avg("weight").alias("_mean"))
    spread = F.sort_array(F.collect_list(F.struct("_mean", "_m"))).alias("_spread")
    per = classes.groupBy("source").agg(F.sum("_size").alias("source_size"), F.sum("_m").alias("_n"), spread)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets(per, weights, most).withColumn("epochs", epochs.cast("bigint"))
    plan = stored(plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint")), "mix-plan")

    count = F.ceil(F.col("_n") / _BUCKET)
    bucket = F.greatest(F.lit(0), F.least(F.floor(share_below(F.col("key"), F.col("_spread"), F.col("_n")) * count), count - 1)).cast("bigint")
    dealt = rows.join(plan.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).withColumn("bucket", bucket)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("_total"))
    sums = stored(sums.select(F.col("source").alias("_b"), F.col("bucket").alias("_k"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("base")), "mix-buckets")
    placed = dealt.join(sums, F.col("source").eqNullSafe(F.col("_b")) & (F.col("bucket") == F.col("_k")))
    order = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead))
    return placed.withColumn("_ahead", ahead).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), "epochs", "row", (F.col("_ahead") < F.col("rest")).alias("drawn"))


def mixture(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """The documents of the mix, same columns: one row for each time that a document is taken, whole documents only.

    The document in which a budget ends is kept whole; documents without words are drawn like the others.  Of equal rows
    each comes as often as the luckiest.  The texts are shuffled once, by id and hash, at every size.
    """
    picks = mixed(docs, quality, weights, most, seed).groupBy("doc_id", "row").agg(F.max(F.col("epochs") + F.col("drawn").cast("int")).alias("_copies")).where("_copies > 0")
    picks = stored(picks.select("doc_id", "row", "_copies"), "mix-picks")
    taken = docs.join(picks.hint("merge"), docs["doc_id"].eqNullSafe(picks["doc_id"]) & (F.xxhash64(docs["source"], docs["text"]) == picks["row"]))
    times = taken.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), F.explode(F.sequence(F.lit(1), picks["_copies"].cast("int"))))
    return times.select("doc.*")
