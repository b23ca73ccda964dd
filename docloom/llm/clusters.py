"""Centroid clustering of quantised vectors, each distinct vector once with its multiplicity.

Vectors are quantised to integers, equal ones are grouped by a partial aggregation, and Lloyd's rounds run on the distinct
ones: a task sums its vectors, weighed by their multiplicity, for each centroid in exact integers, and the tasks' sums are
added by Spark.  Only centroids (``k`` times the dimensions) reach the driver.  The last assignment joins back to the rows.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

_MOST = (1 << 63) - 1
_OUT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, q array<bigint>)``: ``floor(scale * x)`` of rows with ``dims`` components, none null or non-finite."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(F.col(vector_col).isNotNull()).where(F.size(x) == dims).where(~odd)
    return kept.select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("q"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _exact(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which squared distances are exact: doubles while they stay below 2^53, else Python's integers."""
    largest = max(int(np.abs(x.astype(float)).max(initial=0)) for x in (q, centroids))
    kind = np.float64 if q.shape[1] * (2 * largest + 2) ** 2 < 1 << 53 else object
    return q.astype(kind), centroids.astype(kind)


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``q`` the nearest centroid, ties to the smaller number, and the squared distance; exact."""
    a, c = _exact(q, centroids)
    if a.dtype == object:
        apart = np.stack([((a - row) ** 2).sum(axis=1) for row in c], axis=1)
    else:
        apart = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]
    return apart.argmin(axis=1), apart.min(axis=1)


def _totals(distinct: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """For each centroid with vectors: the weighted sums of their components, and last their number."""
    k, dims = centroids.shape

    def run(batches):
        sums = np.zeros((k, dims + 1), object)
        for b in batches:
            if not b.num_rows:
                continue
            q, n = _matrix(b.column(0), dims), b.column(1).to_numpy()
            to = nearest(q, centroids)[0]
            small = int(np.abs(q.astype(float)).max()) * int(n.sum()) < 1 << 62
            for c in np.unique(to):
                rows = q[to == c] if small else q[to == c].astype(object)
                weights = n[to == c]
                sums[c, :dims] += (rows * weights[:, None]).sum(axis=0).astype(object)
                sums[c, dims] += int(weights.sum())
        used = [c for c in range(k) if sums[c, dims]]
        columns = [[c for c in used for _ in range(dims + 1)], [*range(dims + 1)] * len(used), [Decimal(int(x)) for c in used for x in sums[c]]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.decimal128(38, 0)))], ["c", "d", "s"])

    parts = distinct.select("q", "n").mapInArrow(run, "c int, d int, s decimal(38,0)").groupBy("c", "d").agg(F.sum("s").alias("s"))
    found: dict[int, list[int]] = {}
    for r in parts.collect():  # k * (dims + 1) rows at most
        found.setdefault(r["c"], [0] * (dims + 1))[r["d"]] = int(r["s"])
    return found


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after ``rounds`` over ``distinct(q, n)``: componentwise ``floor(sum / count)``; an empty one stays."""
    for _ in range(rounds):
        centroids = centroids.copy()
        for c, (*sums, count) in _totals(distinct, centroids).items():
            centroids[c] = [s // count for s in sums]
    return centroids


def clustered(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for each row with a whole vector.

    Rows whose vector is null, has another length, or a null or non-finite component aren't returned.  The first centroids are the
    ``k`` rows with the smallest SHA-256 of ``1:<vec_id>``; equal ids are ordered by vector, null ids come last, and with fewer rows
    there are fewer centroids.  Repeated rows count each and return each.  Components beyond a long saturate, as do distances and
    sums beyond one.  Extra columns are ignored.  An empty table returns no rows.
    """
    spark = vectors.sparkSession
    each = stored(quantised(vectors, dims, scale, id_col, vector_col), "vectors-quantised")
    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    first = [r["q"] for r in each.orderBy(order.asc_nulls_last(), "q").limit(k).select("q").collect()]
    if not first:
        return spark.createDataFrame([], _OUT)
    distinct = stored(each.groupBy("q").agg(F.count("*").alias("n")), "vectors-distinct")
    centroids = lloyd(distinct, np.array(first, np.int64), rounds)

    def run(batches):
        for b in batches:
            to, apart = nearest(_matrix(b.column(0), dims), centroids) if b.num_rows else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to, pa.int32()), pa.array([min(int(d), _MOST) for d in apart], pa.int64())], ["q", "n", "cluster", "distance"])

    assigned = stored(distinct.mapInArrow(run, "q array<bigint>, n bigint, cluster int, distance bigint"), "vectors-assigned")
    weighed = F.sum(F.col("distance").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)"))
    inertia = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(weighed.alias("total")).collect()}
    whole = min(sum(inertia.values()), _MOST)
    told = [(c, min(total, _MOST), whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, total in inertia.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    rows = each.join(assigned.select("q", "cluster", "distance"), "q")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
