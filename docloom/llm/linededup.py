"""Boilerplate lines by their spread over sites.

Each line's hash gets a HyperLogLog sketch of the sites that it occurs on; sketches merge in the aggregation.  Estimates far
from the threshold decide; lines near it get an exact distinct count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: lgK of a sketch (4,096 registers: a relative error of 1.6 %), and the band around the threshold that is counted exactly.
PRECISION = 12
BAND = 0.25
#: What doesn't count at a line's ends; the carriage return of a line that ends in both is among it.
BLANKS = " \t\x0b\x0c\r"
#: A line is known by two 64-bit hashes of different seeds: at 10^13 lines one alone would take some different lines for equal.
KEY = ["hash", "check"]


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), *more, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(BLANKS))).where("line <> ''")
    return rows.withColumns({"hash": F.xxhash64("line"), "check": F.xxhash64(F.lit(1), "line")}).drop("line")


def widespread_lines(docs: DataFrame, sites: int = 10) -> DataFrame:
    """``(hash, check, sites)`` of the lines of ``docs(doc_id, text, source)`` on ``sites`` different sources or more.

    ``sites`` is exact near the threshold, estimated above it.  A line is what stands between newlines, without outer
    blanks (spaces, tabs, carriage returns and the like); blank ones don't count.  The null source is a site.
    """
    lines = _lines(docs, "source").withColumn("site", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sketched = lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", PRECISION).alias("sketch"))
    spread = stored(sketched.select(*KEY, F.hll_sketch_estimate("sketch").alias("about")).where(F.col("about") >= sites * (1 - BAND)), "line-spread")
    near = spread.where(F.col("about") < sites * (1 + BAND)).select(*KEY)
    exact = lines.join(near, KEY).select(*KEY, "site").distinct().groupBy(*KEY).agg(F.count("*").alias("sites")).where(F.col("sites") >= sites)
    return stored(spread.where(F.col("about") >= sites * (1 + BAND)).select(*KEY, F.col("about").alias("sites")).union(exact), "widespread")


def boilerplate_removed(docs: DataFrame, sites: int = 10) -> DataFrame:
    """Every row of ``docs`` with ``n_lines``, ``n_removed`` and ``kept``, the text without cross-site boilerplate lines.

    Columns of these names are replaced.  Null texts have no lines and stay null.  Equal rows each return one row; null ids are
    ordinary; an empty table returns no rows.  The plan is the same at every size: one shuffle of the texts by id and hash.
    """
    found = _lines(docs).join(widespread_lines(docs, sites).select(*KEY), KEY).groupBy("doc_id", "row").agg(F.collect_set("at").alias("_gone"))
    found = stored(found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "_gone"), "line-places")
    rows = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_row"]), "left")
    lines = F.split(docs["text"], "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(found["_gone"], i))
    return rows.select(
        *[docs[c] for c in docs.columns if c not in ("n_lines", "n_removed", "kept")],
        F.coalesce(F.size(lines), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size(found["_gone"]), F.lit(0)).alias("n_removed"),
        F.when(found["_gone"].isNull(), docs["text"]).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
