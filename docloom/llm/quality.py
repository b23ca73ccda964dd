"""Ordinal quality classifier: a cumulative-link regression on hashed text.

Graded ratings 0 < 1 < ... < K - 1 share one weight vector; ordered thresholds cut its score: P(grade > k) is the
logistic of w.x - t_k.  The expected grade is the sum of these over k, and selection asks for the tail probability
of the grade wanted.

Weights are fitted on a bounded sample of rated documents (``sample``); scoring covers all.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEED

BITS = 18
_WORD = re.compile(r"[^\W_]+")
_MARKS = re.compile(r"[^\w\s]{2,}")
_SHAPES = 20
#: numpy counts and sums over 64-bit copies of what it is given, so features go there in slices, and rows in blocks.
_SLICE = 1 << 20
_ROWS = 2048


def features(text: str) -> np.ndarray:
    """The sorted distinct hashed features of a whole text: its words, lowered, their first letters, runs
    of marks, and binned ratios of its shape.

    None for a text without words.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.int32)
    distinct = set(words)
    distinct |= {f"^{w[:5]}" for w in distinct if len(w) > 5} | {f"~{m[:3]}" for m in _MARKS.findall(text)}
    found = {zlib.crc32(w.encode()) & ((1 << BITS) - 1) for w in distinct}
    letters = sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = list(zip(words, words[1:])) or [("", "")]
    shape = {
        "pairs": 1 - len(set(pairs)) / len(pairs),
        "lines": 1 - len(set(lines)) / len(lines),
        "upper": 2 * sum(map(str.isupper, text)) / letters,
        "other": 4 * (len(text) - letters - text.count(" ") - text.count("\n")) / len(text),
        "long": letters / len(words) / 16,
    }
    found |= {zlib.crc32(f"\0{k}{min(_SHAPES - 1, int(v * _SHAPES))}".encode()) & ((1 << BITS) - 1) for k, v in shape.items()}
    return np.array(sorted(found), np.int32)


class OrdinalModel:
    """Weights over hashed features and K - 1 increasing thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights.astype(np.float32), thresholds

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= K - 1)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - float(self.weights[found].sum()), -50, 50)))


def counted(flat: np.ndarray) -> np.ndarray:
    """How often each hashed feature is in ``flat``."""
    out = np.zeros(1 << BITS, np.int64)
    for at in range(0, len(flat), _SLICE):
        out += np.bincount(flat[at : at + _SLICE], minlength=1 << BITS)
    return out


def contrasts(flat: np.ndarray, sizes: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """For each hashed feature the largest difference, over all cuts between grades, of its smoothed log frequencies below and
    above the cut."""
    out, of = np.zeros(1 << BITS), np.repeat(grades.astype(np.min_scalar_type(int(grades.max()))), sizes)
    for cut in range(1, int(grades.max()) + 1):
        low, high = (np.log((counted(flat[side]) + 1) / (n + 2)) for side, n in ((of < cut, (grades < cut).sum()), (of >= cut, (grades >= cut).sum())))
        out = np.maximum(out, np.abs(low - high))
    return out


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 200, least: int = 5, prior: float = 3.6) -> OrdinalModel:
    """Full-batch Adam on the cumulative-link likelihood with a normal prior of precision ``prior`` on the weights.

    A feature's value is its contrast between grades instead of 1, so that the prior holds words that tell grades apart
    less than words that don't; the model's weights include it.  Features in fewer than ``least`` rows, or than one of 600, weigh nothing.  Thresholds stay in order, as gaps are positive by construction.

    Rows are gone through in blocks, so that besides ``rows`` the driver holds little more than two 32-bit numbers for each feature of a row.
    """
    k = int(grades.max()) + 1
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    used = np.nonzero(counted(flat) >= max(least, len(rows) / 600))[0]
    decay, scale = prior / len(rows), contrasts(flat, sizes, grades)[used]
    del flat
    every = np.arange(len(used), dtype=np.int32)
    compact = np.full(1 << BITS, -1, np.int32)
    compact[used] = every
    blocks = []
    for lo in range(0, len(rows), _ROWS):
        n, col = sizes[lo : lo + _ROWS], compact[np.concatenate(rows[lo : lo + _ROWS])]
        blocks.append((lo, len(n), np.repeat(np.arange(len(n), dtype=np.int32), n)[col >= 0], col[col >= 0]))
    each = np.full(len(rows), 1 / len(rows))
    w, first, gaps = np.zeros(len(used)), np.zeros(1), np.zeros(k - 2)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, first, gaps)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        scaled = w * scale
        eta = np.concatenate([np.bincount(row, scaled[col], n) for _, n, row, col in blocks])
        t = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        # P(y = g) = S(eta - t[g-1]) - S(eta - t[g]), with S at the ends 1 and 0
        s = np.concatenate([np.ones((len(rows), 1)), sigmoid(eta[:, None] - t[None]), np.zeros((len(rows), 1))], axis=1)
        p = np.maximum(s[np.arange(len(rows)), grades] - s[np.arange(len(rows)), grades + 1], 1e-12)
        d = s * (1 - s)
        up, down = d[np.arange(len(rows)), grades], d[np.arange(len(rows)), grades + 1]
        g_eta = -each * (up - down) / p
        g_t = np.zeros(k - 1)
        for j in range(k - 1):
            g_t[j] = (each / p * np.where(grades == j + 1, d[:, j + 1], np.where(grades == j, -d[:, j + 1], 0))).sum()
        tail = np.cumsum(g_t[::-1])[::-1]
        g_w = np.zeros(len(used))
        for lo, _, row, col in blocks:  # the sums so far come first, so that blocks don't change the order of additions
            g_w = np.bincount(np.concatenate([every, col]), np.concatenate([g_w, g_eta[lo + row]]), len(used))
        grads = (g_w * scale + decay * w, tail[:1], tail[1:] * np.exp(gaps))
        for x, g, m in zip((w, first, gaps), grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            x -= 0.05 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9)
    full = np.zeros(1 << BITS)
    full[used] = w * scale
    return OrdinalModel(full, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def grades(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` from the ratings: toxic 0, poor 1, good 2.  Several rows of a document: its worst.

    Rows without an id or without a quality rating, unless toxic, give none.
    """
    grade = F.when(F.col("toxic") > 0, 0).when(F.col("quality") <= 0, 1).when(F.col("quality") > 0, 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, rated: DataFrame, sample: int = 12_000, seed: int = SEED) -> OrdinalModel | None:
    """Fits on at most ``sample`` rated documents, those whose hashed ids are smallest; None without two grades.

    Of several rows with one id the text with the smallest hash counts.  Only their hashed features reach the driver: about a
    kilobyte each.
    """
    chosen = rated.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["grade", "found"])

    texts = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    texts = texts.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.select("grade", "text").mapInArrow(run, "grade int, found array<int>").toArrow()
    found = [x.values.to_numpy() for x in rows.column("found")]  # views of what was received
    known = np.asarray(rows.column("grade").to_pylist(), np.int64)
    order = sorted((i for i in range(len(found)) if len(found[i])), key=lambda i: (int(known[i]), found[i].tobytes()))
    if len({int(known[i]) for i in order}) < 2:
        return None
    return fit([found[i] for i in order], known[order])


def scored(docs: DataFrame, model: OrdinalModel | None, wanted: int = 2, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """Every row of ``docs`` with an expected grade and a tail probability, that of a grade of ``wanted`` or more, under ``names``.

    Columns of these names are replaced.  Rows without words get 0 for both; without a model both are null.
    """
    expected, tail = names
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in names})

    @F.pandas_udf("expected_grade double, tail_probability double")
    def score(texts):
        import pandas as pd

        out = []
        for t in texts:
            found = features(t or "")
            tails = model.tails(found) if len(found) else np.zeros(len(model.thresholds))
            out.append((float(tails.sum()), float(tails[wanted - 1]) if wanted <= len(tails) else 0.0))
        return pd.DataFrame(out, columns=["expected_grade", "tail_probability"])

    # Declared as not deterministic, so that a filter on a score doesn't evaluate it a second time.
    rows = docs.drop(*names).withColumn("__score", score.asNondeterministic()("text"))
    return rows.select("*", F.col("__score.expected_grade").alias(expected), F.col("__score.tail_probability").alias(tail)).drop("__score")


def selected(docs: DataFrame, labels: DataFrame, least: float = 0.4, sample: int = 12_000, names: tuple[str, str] = ("expected_grade", "tail_probability")) -> DataFrame:
    """The rows of ``docs`` whose probability of the best grade is ``least`` or more, with both scores under ``names``.

    Rows without words are rejected.  Null ids are scored like others.  Without ratings of two grades nothing is rejected, and
    scores are null.
    """
    model = train(docs, grades(labels), sample)
    rows = scored(docs, model, names=names)
    return rows if model is None else rows.where(F.col(names[1]) >= least)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, same columns, without the rows that ``selected`` rejects; equal rows are judged alike and each stays or goes."""
    return selected(docs, labels, names=("__expected_grade", "__tail_probability")).select(*docs.columns)
