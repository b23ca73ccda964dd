"""Repeated-passage removal over a log-structured fingerprint index.

A window is ``width`` consecutive words.  Storing each window would cost several times the text, so the index keeps a
window's fingerprint: the smallest hash among the word runs of half its length inside it.  The window's words alone
decide it, so equal windows always share it, and neighbouring windows mostly do, which leaves about one row
for thirteen words.

Each batch of documents becomes a sorted immutable run: heads, one row for a fingerprint, bucketed by ``fp``, and places
``(fp, part, doc_id)``, bucketed by ``(fp, part)``.  A fingerprint that many documents share is dealt over several parts,
so no bucket holds all its places.  Runs with the same number of buckets are merge-joined bucket by bucket without a
shuffle: the heads of the new run against the historical ones, then the places under the shared fingerprints.
Documents that share a fingerprint are then verified: all their windows under shared fingerprints are compared by two 64-bit
hashes of the whole word sequence, from different hash functions of the words.  Compaction merges the runs into one.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import deleted, discard, release, scratch, stored

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i up to n at least."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = 1 << max(12, n.bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            both.append(np.multiply.accumulate(step))
        _POWERS[base] = tuple(both)
    up, down = _POWERS[base]
    return up[:n], down[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _runs_of(hashes: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive word hashes."""
    up, down = _powers(base, len(hashes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
    return _mixed((total[n:] - total[:-n]) * down[: len(hashes) - n + 1])


def _word_hashes(words: list[bytes], of=xxhash.xxh3_64_intdigest) -> np.ndarray:
    return np.fromiter(map(of, words), np.uint64, len(words))


def window_fingerprints(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` words the smallest hash of its runs of ``width // 2`` words."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    low, reach = _runs_of(hashes, width // 2, _BASES[0]), width - width // 2 + 1
    size = 1
    while size * 2 <= reach:
        low, size = np.minimum(low[:-size], low[size:]), size * 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    return low.view(np.int64)


def _int64(x) -> pa.Array:
    return pa.array(np.asarray(x, np.int64), pa.int64())


def _summaries(docs: DataFrame) -> DataFrame:
    """``(doc_id, row, n_words, words_sha)`` of every document."""

    def run(batches):
        for b in batches:
            parts = [(t.as_py() or b"").split() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _int64([len(p) for p in parts]), pa.array([hashlib.sha256(b" ".join(p)).digest() for p in parts], pa.binary())], ["doc_id", "row", "n_words", "words_sha"])

    return docs.mapInArrow(run, "doc_id bigint, row bigint, n_words bigint, words_sha binary")


def _run_rows(docs: DataFrame, width: int) -> DataFrame:
    """The run of a batch: ``(fp, doc_id)``, each once for a document."""

    def run(batches):
        for b in batches:
            ids, fps = b.column(0).to_numpy(zero_copy_only=False), []
            for t in b.column(2):
                words = (t.as_py() or b"").split()
                fps.append(np.unique(window_fingerprints(_word_hashes(words), width)) if len(words) >= width else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([_int64(np.concatenate(fps) if fps else []), _int64(np.repeat(ids, [len(x) for x in fps]))], ["fp", "doc_id"])

    return docs.mapInArrow(run, "fp bigint, doc_id bigint")


def _windows(found: DataFrame, width: int) -> DataFrame:
    """``(h1, h2, doc_id, row, at)`` of each window under the fingerprints in ``fps``."""

    def run(batches):
        for b in batches:
            for i, t in enumerate(b.column(2)):
                words = t.as_py().split()
                hashes = _word_hashes(words)
                at = np.nonzero(np.isin(window_fingerprints(hashes, width), np.asarray(b.column(3)[i].as_py(), np.int64)))[0]
                if len(at):
                    one, two = (_runs_of(h, width, base)[at].view(np.int64) for h, base in zip((hashes, _word_hashes(words, xxhash.xxh64_intdigest)), _BASES))
                    yield pa.RecordBatch.from_arrays([_int64(one), _int64(two), _int64(np.full(len(at), b.column(0)[i].as_py())), _int64(np.full(len(at), b.column(1)[i].as_py())), pa.array(at.astype(np.int32), pa.int32())], ["h1", "h2", "doc_id", "row", "at"])

    return found.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, row bigint, at int")


def _cut(found: DataFrame, width: int) -> DataFrame:
    """``found(doc_id, row, text, at)`` without the words that the windows starting ``at`` cover."""

    def run(batches):
        for b in batches:
            gone, left, texts = [], [], []
            for t, at in zip(b.column(2), b.column(3)):
                words = t.as_py().split()
                edge = np.zeros(len(words) + 1, np.int32)
                starts = np.asarray(at.as_py(), np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + width, -1)
                kept = np.cumsum(edge[:-1]) == 0
                texts.append(b" ".join([w for w, k in zip(words, kept) if k]))
                gone.append(len(words) - int(kept.sum()))
                left.append(hashlib.sha256(texts[-1]).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _int64(gone), pa.array(left, pa.binary())], ["doc_id", "row", "gone", "left_sha"])

    return found.mapInArrow(run, "doc_id bigint, row bigint, gone bigint, left_sha binary")


class FingerprintIndex:
    """Immutable sorted runs of past batches; ``add`` removes repeats from a new batch and appends its run.

    Batches come in ascending ``doc_id`` order: a document is held against all documents with a smaller id, of
    earlier batches or its own; earlier results are not revised.
    """

    def __init__(self, spark: SparkSession, width: int = 50, buckets: int | None = None):
        self.spark, self.width, self.buckets = spark, width, buckets or common.width(spark)
        self.runs: list[str] = []
        self._paths: dict[str, str] = {}
        self.docs: list[DataFrame] = []
        self.texts: DataFrame | None = None
        self.seen: DataFrame | None = None

    def _table(self, rows: DataFrame, name: str, *keys: str) -> None:
        self._paths[name] = scratch(self.spark, "run")
        out = rows.write.format("parquet").option("compression", "zstd").option("path", self._paths[name])
        out.bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(name)

    def _heads(self, name: str) -> DataFrame:
        return self.spark.table(f"{name}_heads")

    def _write_run(self, rows: DataFrame, heads: DataFrame) -> str:
        """A run of ``rows(fp, doc_id)`` and ``heads(fp, lo, hi, n)``.

        ``limit`` is a quarter of a bucket's mean; a fingerprint with more places takes ``n / limit`` parts by hash of the
        id.  At most ``4 * buckets`` fingerprints can have so many places, which bounds the broadcast.
        """
        name = f"docloom_run_{uuid.uuid4().hex[:12]}"
        limit = max(1, -(-rows.count() // (4 * self.buckets)))
        self._table(heads.withColumn("parts", F.expr(f"cast((n - 1) div {limit} + 1 as int)")), f"{name}_heads", "fp")
        hot = self._heads(name).where("parts > 1").select("fp", "parts")
        part = F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0)).cast("int").alias("part")
        places = rows.join(F.broadcast(hot), "fp", "left").select("fp", part, "doc_id")
        self._table(places.repartition(self.buckets, "fp", "part"), name, "fp", "part")
        return name

    def compact(self) -> None:
        """One run in place of several.

        The runs are read as plain files: grouped over a union of the bucketed tables, rows of one fingerprint stayed
        apart under Spark 4.1.2 (probably an exchange left out; the plan wasn't looked into).
        """
        if len(self.runs) > 1:
            heads = self.spark.read.parquet(*[self._paths[f"{name}_heads"] for name in self.runs])
            heads = heads.groupBy("fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
            rows = self.spark.read.parquet(*[self._paths[name] for name in self.runs]).select("fp", "doc_id")
            old, self.runs = self.runs, [self._write_run(rows, heads)]
            for name in old:
                self._drop(name)

    def _drop(self, run: str) -> None:
        for name in (run, f"{run}_heads"):
            self.spark.sql(f"DROP TABLE {name}")
            deleted(self.spark, self._paths.pop(name))

    def close(self) -> None:
        """Deletes the runs; results that were returned stay."""
        for name in self.runs:
            self._drop(name)
        self.runs = []

    def add(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_words, n_removed, kept_sha256)`` for every row of ``docs(doc_id, text)``.

        A word goes if a window of ``width`` words that covers it also starts in a document with a smaller id.
        Rows with equal ids don't affect each other.  Null texts have no words.  Rows with a null id keep all their
        words and take none from others.
        """
        width = self.width
        texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("binary").alias("text"))
        self.texts = texts if self.texts is None else self.texts.unionByName(texts)
        base = stored(_summaries(texts), "summaries")
        self.seen = base if self.seen is None else self.seen.unionByName(base)
        rows = stored(_run_rows(texts.where("doc_id is not null"), width), "run-rows")
        new = self._write_run(rows, rows.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")))
        discard(rows)
        release(self.spark)

        # Merge-join of the new run with the older ones, bucket by bucket.
        first = self._heads(new).select("fp", "lo", "hi")
        for name in self.runs:
            old = self._heads(name).select("fp", F.col("lo").alias("old"))
            first = first.join(old, "fp", "left").select("fp", F.least("lo", "old").alias("lo"), "hi")
        shared = first.where("lo < hi").select("fp")
        self.runs.append(new)
        rows = []
        for name in self.runs:
            parts = self._heads(name).join(shared, "fp").select("fp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
            rows.append(self.spark.table(name).join(parts, ["fp", "part"], "left_semi").select("fp", "doc_id"))
        for more in rows[1:]:
            rows[0] = rows[0].unionByName(more)

        # Copies of a whole document lose everything; only the first copy is compared further.
        copies = stored(
            self.seen.where(F.col("n_words") >= width)
            .join(stored(self.seen.where("doc_id is not null").groupBy("words_sha").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last"), "leads"), "words_sha")
            .where("doc_id > lead")
            .select("doc_id", "row")
            .distinct(),
            "copies",
        )
        candidates = stored(rows[0].groupBy("doc_id").agg(F.collect_set("fp").alias("fps")), "candidates")
        found = self.texts.join(candidates, "doc_id").join(copies, ["doc_id", "row"], "left_anti").select("doc_id", "row", "text", "fps")
        found = stored(found, "candidate-texts")
        release(self.spark)

        windows = _windows(found, width)  # made again below: reading them back costs more
        origin = stored(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "origins")
        release(self.spark)
        repeats = windows.join(origin, ["h1", "h2"]).where("doc_id > lo").groupBy("doc_id", "row").agg(F.collect_set("at").alias("at"))
        repeats = stored(repeats, "repeats")
        discard(origin)
        cut = stored(_cut(found.join(repeats, ["doc_id", "row"]).select("doc_id", "row", "text", "at"), width).distinct(), "cut")
        release(self.spark)

        nothing = F.sha2(F.lit("").cast("binary"), 256)
        return (
            base.join(cut, ["doc_id", "row"], "left")
            .join(copies.withColumn("copy", F.lit(True)), ["doc_id", "row"], "left")
            .select(
                "doc_id",
                "n_words",
                F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("bigint").alias("n_removed"),
                F.when(F.col("copy"), nothing).otherwise(F.lower(F.hex(F.coalesce("left_sha", "words_sha")))).alias("kept_sha256"),
            )
        )


def repeats_removed(docs: DataFrame, width: int = 50, batches: int = 2) -> DataFrame:
    """Adds all of ``docs(doc_id, text)`` to an empty index in ``batches`` ascending ranges of ids; see ``FingerprintIndex.add``.

    Extra columns are ignored; an empty table returns no rows.
    """
    index = FingerprintIndex(docs.sparkSession, width)
    out = None
    for part in common.id_ranges(docs, batches):
        done = index.add(part)
        index.compact()
        out = done if out is None else out.unionByName(done)
    index.close()
    return out
