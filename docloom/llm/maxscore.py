"""Ranked lexical search: the best documents for each item, by MaxScore within shards of the corpus.

A first pass turns each whole text into its length and the counts of those terms that the items have; corpus statistics are
aggregated from all rows of it.  A second pass takes this forward index shard by shard, inverts a shard into postings with exact
impacts, and searches it for each item: terms whose upper bounds together can't lift a document to the item's threshold
are non-essential, so only documents on the other lists are candidates, and non-essential postings are probed from the highest
bound down while a candidate can still qualify.  Thresholds carry over from shard to shard of a task.  A task returns each item's
best documents, and a ranking over these gives the result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of terms as they are, A-Z lowered, all other ASCII blank.
_TABLE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Documents of a shard.
SHARD = 4096
#: Terms of all items that are searched together, about; more items are dealt into blocks, each searched against all documents.
BLOCK_TERMS = 250_000


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, in order: runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, terms array<int>, tfs array<int>)`` for each row: all its terms' number, and those in the vocabulary with counts."""

    def run(batches):
        known = vocabulary.get
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                n, ids, tfs, ends = [], [], [], [0]
                for text in c.column(1):
                    found = terms(text.as_py())
                    n.append(len(found))
                    for t, tf in Counter(found).items():
                        if (t := known(t)) is not None:
                            ids.append(t)
                            tfs.append(tf)
                    ends.append(len(ids))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, tfs)]
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


class Shard:
    """Postings of some documents: for each term its documents' places and impacts, and the highest impact as upper bound."""

    def __init__(self, ids, known, n, lists, tfs, weights: np.ndarray, docs: int, length: int):
        self.ids, self.known, self.size = ids, known, len(n)
        flat, tf = lists.flatten().to_numpy(), tfs.flatten().to_numpy().astype(np.int64)
        at = np.repeat(np.arange(self.size), np.diff(lists.offsets.to_numpy()))
        m = np.array([50 + 50 * x * docs // length for x in n.tolist()], np.int64)
        impact = weights[flat] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at]))
        order = np.argsort(flat, kind="stable")
        self.at, self.impact = at[order], impact[order]
        self.terms, starts = np.unique(flat[order], return_index=True)
        self.starts = np.append(starts, len(flat))
        self.bounds = np.maximum.reduceat(self.impact, starts) if len(starts) else np.zeros(0, np.int64)
        self.scores = np.zeros(self.size, np.int64)

    def search(self, wanted: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that score ``least`` or more for the sorted term ids ``wanted``."""
        lists = np.flatnonzero(np.isin(self.terms, wanted, assume_unique=True))
        lists = lists[np.argsort(self.bounds[lists], kind="stable")]
        reach = np.cumsum(self.bounds[lists])
        first = int(np.searchsorted(reach, least))  # below it, all lists together stay under the threshold
        if first == len(lists):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        scores = self.scores
        for t in lists[first:]:
            lo, hi = self.starts[t], self.starts[t + 1]
            scores[self.at[lo:hi]] += self.impact[lo:hi]
        places = np.flatnonzero(scores)
        found = scores[places]
        scores[places] = 0
        for k in range(first - 1, -1, -1):
            open_ = found + reach[k] >= least
            places, found = places[open_], found[open_]
            if not len(places):
                break
            lo, hi = self.starts[lists[k]], self.starts[lists[k] + 1]
            posted = self.at[lo:hi]
            to = np.minimum(np.searchsorted(posted, places), len(posted) - 1)
            found = found + np.where(posted[to] == places, self.impact[lo:hi][to], 0)
        enough = found >= least
        return places[enough], found[enough]


def best(scores: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` highest scores; equal ones by ascending id, null ids (not ``known``) last."""
    if len(scores) > k:
        at = np.lexsort((ids, ~known, -scores))[:k]
        return scores[at], known[at], ids[at]
    return scores, known, ids


def _searched(index: DataFrame, items: list[tuple[int, int | None, np.ndarray]], weights: np.ndarray, docs: int, length: int, k: int) -> DataFrame:
    """``(item, item_id, doc_id, score)``: each task's best ``k`` documents for each of ``items``."""

    def run(batches):
        none = np.zeros(0, np.int64)
        tops = [(none, none.astype(bool), none)] * len(items)
        for b in batches:
            for lo in range(0, b.num_rows, SHARD):
                c = b.slice(lo, SHARD)
                ids = c.column(0)
                shard = Shard(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), *c.columns[1:], weights, docs, length) if length else None
                for i, (_, _, wanted) in enumerate(items):
                    scores, known, found = tops[i]
                    at, more = shard.search(wanted, int(scores.min()) if len(scores) == k else 1) if shard else (none, none)
                    if len(at):
                        tops[i] = best(np.append(scores, more), np.append(known, shard.known[at]), np.append(found, shard.ids[at]), k)
        for (item, item_id, _), (scores, known, ids) in zip(items, tops):
            size = len(scores)
            if size:
                columns = [pa.array([x] * size, pa.int64()) for x in (item, item_id)] + [pa.array(ids, pa.int64(), mask=~known), pa.array(scores, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(run, "item bigint, item_id bigint, doc_id bigint, score bigint")


def _item_terms(items: DataFrame) -> DataFrame:
    """``(item, item_id, term binary)`` of ``items(item, item_id, text)``: each term once."""

    def run(batches):
        for b in batches:
            rows = [(i.as_py(), j.as_py(), t) for i, j, text in zip(*b.columns) for t in sorted(set(terms(text.as_py())))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 3, (pa.int64(), pa.int64(), pa.binary()))], ["item", "item_id", "term"])

    return items.mapInArrow(run, "item bigint, item_id bigint, term binary")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above 0 for each row of ``items(item_id, text)``.

    Terms, weights and scores are in integers, see ``Shard``; equal scores are ranked by ascending id, null ids last.  Null and empty
    texts have no terms: such documents don't count as documents, such items return nothing.  Repeated documents rank each, and
    repeated items are answered each.  Extra columns are ignored.  Empty tables return no rows.
    """
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text"))
    asked = stored(_item_terms(rows), "search-terms")
    blocks = -(-asked.count() // block_terms) or 1
    parts = []
    for block in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()
        vocabulary = {t: i for i, t in enumerate(sorted(set(mine.column("term").to_pylist())))}
        wanted: dict[tuple, list[int]] = {}
        for item, item_id, term in zip(*(mine.column(c).to_pylist() for c in ("item", "item_id", "term"))):
            wanted.setdefault((item, item_id), []).append(vocabulary[term])
        index = stored(forward_index(docs, vocabulary, id_col, text_col), "search-index")
        n, length = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = {r["t"]: r["df"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        parts.append(stored(_searched(index, [(*key, np.array(sorted(t))) for key, t in wanted.items()], weights, n, length, k), "search-found"))
    found = functools.reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
