"""Secret scans over an incremental blob ledger.

A text is a blob, addressed by the SHA-256 of its UTF-8.  The ledger has a row for each blob and rule version that was
scanned, findings or none.  A scan takes the blobs that some path refers to, leaves out those that the ledger has
for this rule version, scans each other once however many paths hold it, and joins findings back to all paths.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_ranges, release, stored

#: The base kinds, in the order of ties, with the length that a match must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a greedy run from its first character on, so the same as a run with short ones dropped
#: Further kinds.
FURTHER = {
    "private_key": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    "code_host": re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})"),
    "chat": re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    "url_login": re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,200}@"),
}
#: A text without one of these has no match of the kind, so its pattern needn't run.
_NEEDS = {"private_key": "PRIVATE KEY-----", "jwt": "eyJ", "chat": "xox", "url_login": "://"}
KINDS = ["assign", "access", "hex", *FURTHER]
RULES = "1:" + hashlib.sha256("\n".join([ASSIGN.pattern, ACCESS.pattern, HEX.pattern, *(f"{k} {p.pattern}" for k, p in FURTHER.items())]).encode()).hexdigest()[:16]


def spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, index in KINDS, end)`` of every secret in a whole text, in code points, end exclusive, sorted."""
    found, low = [], text.lower()
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (kind, pattern) in enumerate(FURTHER.items(), 3):
        if kind not in _NEEDS or _NEEDS[kind] in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    return sorted(found)


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


_LEDGER = "blob binary, rules string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scanned(blobs: DataFrame, rules: str = RULES) -> DataFrame:
    """Ledger rows for ``blobs(blob, text)``: one for each row."""

    def run(batches):
        for b in batches:
            out = []
            for blob, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = spans(text.as_py())
                base = [x for x in found if x[1] < 3]
                out.append((blob, rules, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found)))
            names = [x.split()[0] for x in _LEDGER.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()))], names) if out else pa.RecordBatch.from_pylist([], pa.schema([(n, t) for n, t in zip(names, (pa.binary(), pa.string(), *[pa.int64()] * 3, pa.string(), pa.string()))]))

    return blobs.mapInArrow(run, _LEDGER)


def with_blobs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``blob``, the content address of a whole text (null: empty)."""
    return docs.withColumn("blob", F.unhex(F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256)))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules: str = RULES, text_col: str = "text") -> DataFrame:
    """``ledger`` and the rows of all blobs in ``docs`` that it lacks for this rule version; those are stored before it returns.

    Rows with equal texts are one blob, whatever their paths and versions.  The ledger's rows, of other rule versions too, stay as they are.
    """
    # Copies go before the shuffle; the join meets the blobs where that left them.
    texts = with_blobs(docs.select(F.coalesce(text_col, F.lit("")).alias("text"))).dropDuplicates(["blob"])
    if ledger is not None:
        texts = texts.join(ledger.where(F.col("rules") == rules).select("blob").hint("merge"), "blob", "left_anti")
    new = stored(scanned(texts.select("blob", "text"), rules), "ledger")
    release(docs.sparkSession)
    return new if ledger is None else ledger.unionByName(new)


def findings(docs: DataFrame, ledger: DataFrame, rules: str = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_assign, n_access, n_hex, base_sha256, spans, blob)`` for every row of ``docs``, joined from the ledger.

    Most blobs have no span: only those with some are joined, the others' row is the same constant.  A null id is an
    ordinary value; equal rows each return one; extra columns are ignored; an empty table returns no rows.
    """
    held = stored(ledger.where((F.col("rules") == rules) & (F.col("spans") != "")).drop("rules"), "held")
    none = hashlib.sha256(b"").hexdigest()
    paths = with_blobs(docs.select(id_col, text_col)).select(id_col, "blob")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return paths.join(held, "blob", "left").select(id_col, *counts, F.coalesce("base_sha256", F.lit(none)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.lower(F.hex("blob")).alias("blob"))


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, batches: int = 2) -> DataFrame:
    """Brings all of ``docs(doc_id, text)`` to the ledger in ``batches`` ascending ranges of ids and returns the findings of all rows.

    Each range is scanned only for blobs that neither ``ledger`` nor an earlier range has under this rule version.  Null ids are in the
    first range.
    """
    for part in id_ranges(docs, batches):
        ledger = update_ledger(part, ledger)
    return findings(docs, ledger)
