"""Helpers that the corpus operators share: tables, shared folders, ordered buckets, components."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 20240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder; a cluster session is refused,
    because a machine-local folder would lose what other executors have to read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (option := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = option.get().rsplit("/", 1)[0]
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, found, True)
        found = f"file://{found}"
        spark.conf.set("spark.docloom.local.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found if re.match(r"[a-zA-Z][\w+.-]*:", found) else f"file://{os.path.abspath(found)}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; each call gets its own."""
    base = spark.conf.get("spark.docloom.local.dir", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends, lost executors cost nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored frames that nothing lazy refers to any more."""
    for df in frames:
        deleted(df.sparkSession, df._stored_at)


def deleted(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, cleaned with the frame; for tables that a loop replaces."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished phases now, not when the driver next happens to collect garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    """How many partitions a keyed shuffle takes here."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """Up to ``buckets - 1`` increasing upper bounds that deal the values of an ordered column out evenly.

    Only the bounds reach the driver; the quantile sketch scans one column.
    """
    found = df.stat.approxQuantile(column, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets)) if buckets > 1 else []
    return sorted({int(x) for x in found})


def id_ranges(docs: DataFrame, n: int, id_col: str = "doc_id") -> list[DataFrame]:
    """``docs`` in up to ``n`` ascending ranges of ids of about equal size; null ids are in the first."""
    at = F.col(id_col).cast("bigint")
    bounds = range_bounds(docs.select(at.alias(id_col)), id_col, n)
    parts = []
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = docs if low is None else docs.where(at > low)
        parts.append(part if high is None else part.where((at <= high) | at.isNull() if low is None else at <= high))
    return parts


def bucket_of(column, bounds: list):
    """0 for null, else 1 + the number of bounds below the value, by binary search."""
    if not bounds:
        return F.when(column.isNull(), 0).otherwise(1)
    edges = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    further = lambda at, step: F.when((at + step <= len(bounds)) & (F.get(edges, at + step - 1) < column), at + step).otherwise(at)
    return F.when(column.isNull(), 0).otherwise(F.aggregate(steps, F.lit(0), further) + 1)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(node, root)``; the root is the smallest node.

    Alternates the large-star and small-star steps (each a partial aggregation and an equi-join, so that a hub's
    edges are never gathered in one place) until the edge set stays the same.  Both steps only replace edges,
    so the work stays linear in the number of edges and the rounds are logarithmic in practice.
    No edges: no rows.  Self-loops are ignored.
    """
    e = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    sign = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == sign or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b")).distinct()
        sign = tuple(now)
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        e = checkpointed(small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a <> b").distinct())
