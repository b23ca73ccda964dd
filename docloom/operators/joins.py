"""Joins on time and on ranges that stay equi-joins or windows: nothing is compared with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: dict[str, str], times: tuple[str, str], bucket: str = "30 days") -> DataFrame:
    """Each row of ``left`` with the latest row of ``right`` of the same key that isn't later; nulls where there is none.

    ``keys`` maps columns of the left side to the right side's, ``times`` names both sides' times; other column names must differ.
    Of right rows with equal key and time the greatest counts.  Null keys and times find nothing.  Both sides are one sequence in
    order of time, in which the last right row is carried on.  A sequence is cut at multiples of ``bucket``, so a key with very many
    rows fills many tasks; what one piece hands on to the next is a row for each piece.
    """
    own = list(left.columns)
    value = F.struct(F.col(times[1]).alias("_time"), *[F.col(c) for c in right.columns])
    piece = lambda t: F.window(F.col(t).cast("timestamp"), bucket)["start"]
    named = [F.col(r).alias(f"_key{i}") for i, r in enumerate(keys.values())]
    mine = left.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)], F.col(times[0]).alias("_at"), F.lit(1).alias("_side"), F.struct(*own).alias("_left"))
    there = right.where(F.col(times[1]).isNotNull()).select(*named, F.col(times[1]).alias("_at"), F.lit(0).alias("_side"), value.alias("_right"))
    key = [f"_key{i}" for i in range(len(keys))]
    timed = mine.where("_at is not null").unionByName(there, allowMissingColumns=True).withColumn("_piece", piece("_at"))
    order = Window.partitionBy(*key, "_piece").orderBy("_at", "_side", "_right")
    found = timed.withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    ends = timed.groupBy(*key, "_piece").agg(F.max("_right").alias("_last"))
    before = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(Window.partitionBy(*key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    whole = found.join(before, [*key, "_piece"], "left").withColumn("_found", F.coalesce("_found", "_carried"))
    known = F.lit(True)
    for k in key:
        known &= F.col(k).isNotNull()
    shown = [F.when(known, F.col("_found")[c]).alias(c) for c in right.columns]
    late = mine.where("_at is null").select("_left.*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns])
    return whole.select("_left.*", *shown).unionByName(late)


def _bin(df: DataFrame, name: str, width: float) -> Column:
    timed = df.schema[name].dataType.simpleString().startswith(("timestamp", "date"))
    x = F.col(name).cast("timestamp") if timed else F.col(name)
    return F.floor(x.cast("double") / F.lit(float(width)))


def within(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of ``points`` and ``ranges`` with ``low <= point < high``; each once.  Empty ranges and nulls match nothing.

    A range goes to each bin of ``width`` that it touches, a point to its own, and the join is on the bin.  ``width`` near the usual
    length of a range keeps both the copies of ranges and the points of a bin few.  Column names must differ; times are in seconds.
    """
    bins = ranges.where(F.col(low) < F.col(high)).withColumn("_bin", F.explode(F.sequence(_bin(ranges, low, width), _bin(ranges, high, width))))
    return points.withColumn("_bin", _bin(points, point, width)).join(bins, "_bin").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


def within_totals(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, value: str, width: float) -> DataFrame:
    """``ranges`` that hold points, with ``n``, how many, and ``total``, the sum of their whole-number ``value`` (null: all of them are).

    The pairs are those of ``within``, but none is made: a range has what lies before its high bound less what lies before its low one.
    Points are added up for each place first, then carried on in order of place within bins of ``width``; what one bin hands on to the
    next is a row for each bin.  So the work grows with points and ranges, not with their pairs.  Column names must differ.
    """
    real = points.schema[point].dataType.simpleString() in ("float", "double")
    placed = points.where(F.col(point).isNotNull() & ~F.isnan(point)) if real else points.where(F.col(point).isNotNull())
    parts = {"_n": F.count("*"), "_known": F.count(value), "_sum": F.coalesce(F.sum(F.col(value).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))}
    some = placed.groupBy(F.col(point).alias("_x")).agg(*[x.alias(c) for c, x in parts.items()]).withColumn("_side", F.lit(1))
    spans = ranges.where(F.col(low) < F.col(high))
    none = [F.lit(0).cast(some.schema[c].dataType).alias(c) for c in parts]
    bounds = spans.select(F.col(low).alias("_x")).union(spans.select(F.col(high).alias("_x"))).distinct().select("_x", *none, F.lit(0).alias("_side"))
    both = some.unionByName(bounds)
    # What is no number comes after all numbers.
    place = F.when(F.isnan("_x"), (1 << 63) - 1).otherwise(_bin(both, "_x", width)) if both.schema["_x"].dataType.simpleString() in ("float", "double") else _bin(both, "_x", width)
    both = both.withColumn("_bin", place)
    order = Window.partitionBy("_bin").orderBy("_x", "_side")
    found = both.select("_x", "_bin", "_side", *[F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in parts]).where("_side = 0")
    ahead = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy("_bin").agg(*[F.sum(c).alias(c) for c in parts]).select("_bin", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in parts])
    found = found.join(before, "_bin").select("_x", *[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in parts])
    at = lambda end: found.select(F.col("_x").alias(f"_x{end}"), *[F.col(c).alias(f"{c}{end}") for c in parts])
    held = spans.join(at(0), F.col(low) == F.col("_x0")).join(at(1), F.col(high) == F.col("_x1")).where("_n1 > _n0")
    total = F.when(F.col("_known1") > F.col("_known0"), F.col("_sum1") - F.col("_sum0")).cast("decimal(38,0)")
    return held.select(*ranges.columns, (F.col("_n1") - F.col("_n0")).alias("n"), total.alias("total"))


def overlapping(a: DataFrame, b: DataFrame, on: dict[str, str], spans: tuple[str, str, str, str], width: float) -> DataFrame:
    """Pairs of rows with equal ``on`` (left column to right column; may be empty) whose half-open spans overlap; each once.

    ``spans`` names start and end of the left side, then of the right.  Both sides go to each bin of ``width`` that they touch, and a pair
    counts in the first bin that both share.  Empty spans and nulls match nothing.  Column names must differ.
    """
    a0, a1, b0, b1 = spans
    binned = lambda df, lo, hi, name: df.where(F.col(lo) < F.col(hi)).withColumn(name, F.explode(F.sequence(_bin(df, lo, width), _bin(df, hi, width))))
    left, right = binned(a, a0, a1, "_bin"), binned(b, b0, b1, "_at")
    same = F.col("_bin") == F.col("_at")
    for x, y in on.items():
        same &= F.col(x) == F.col(y)
    first = F.col("_bin") == F.greatest(_bin(a, a0, width), _bin(b, b0, width))
    return left.join(right, same).where(first & (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))).drop("_bin", "_at")
