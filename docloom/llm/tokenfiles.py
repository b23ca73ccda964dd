"""Token files: flat unsigned integers and 64-bit document offsets, written and memory-mapped by Spark tasks.

A data set is a folder of partitions in ascending id order.  Partition ``k`` has

* ``k.tok``: the token ids of its documents, one after the other (``uint16`` if the vocabulary fits, else ``uint32``),
* ``k.off``: ``n + 1`` little-endian ``uint64`` offsets into it, in tokens,
* ``k.doc``: the number of leading null ids, then ``n`` ids, as little-endian ``int64``,

and one row of the manifest.  Offsets count from the partition's start; its base is the prefix sum of token counts
in the manifest, so partitions are written independently and nothing is renumbered.

Files appear by renaming a finished temporary one, and a partition's content depends on its rows alone: a task that runs twice
writes the same files.  Folders of ``file:`` URIs are opened directly, others through ``pyarrow.fs``.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored, width

#: Blank runs stay with the word that follows: a pre-token never goes on from a word into a blank.
_CHUNK = re.compile(r"\s*\S+|\s+")
#: Blanks to Python, but not to the tokenizer's own splitting.
_ODD = "\x1c\x1d\x1e\x1f"
#: So many new pieces are encoded as one text, with an added token between them.
JOINED = 2048


class Encoder:
    """Encodes whole texts with a ``tokenizers`` file, remembering the ids of text pieces that come again.

    ``memo`` bounds the pieces that a worker remembers; it changes memory and speed, never the ids.  When half of them are new, the older
    half goes, but for pieces that came again.  Texts with an added token's string, or with control characters on whose class the two
    splitters differ, are encoded directly.
    """

    def __init__(self, path: str, memo: int = 1_400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo, self.older, self.most = {}, {}, memo
        added = self.tokenizer.get_added_tokens_decoder()
        self.whole = [*_ODD, *[t.content for t in added.values()]]
        #: An added token that cuts a text without touching what is around it, and its id.
        self.between = next(((t.content, i) for i, t in added.items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)), None)
        self.pieces = self._splits()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def _splits(self) -> bool:
        """Whether texts may be encoded piece by piece: byte-level splitting alone, nothing before it and no blank added in front."""
        first = self.tokenizer.pre_tokenizer
        if first is None or self.tokenizer.normalizer is not None or self.tokenizer.truncation or self.tokenizer.padding:
            return False
        found = json.loads(first.__getstate__())
        return found.get("type") == "ByteLevel" and not found.get("add_prefix_space", True) and found.get("use_regex", False)

    def _bytes(self, ids: list[int]) -> bytes:
        out = array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _direct(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _each(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces without an added token's string, each by itself."""
        if self.between and len(pieces) > 1:
            token, end = self.between
            ids = np.asarray(self.tokenizer.encode_batch_fast([token.join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
            cuts = np.flatnonzero(ids == end)
            if len(cuts) == len(pieces) - 1:
                raw, size = ids.tobytes(), self.dtype.itemsize
                return [raw[a:b] for a, b in zip([0, *((cuts + 1) * size).tolist()], [*(cuts * size).tolist(), len(raw)])]
        return [np.asarray(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        split = [None if not self.pieces or any(x in t for x in self.whole) else _CHUNK.findall(t) for t in texts]
        if len(self.memo) > self.most // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = {c for s in split if s for c in s if c not in memo}
        for c in [c for c in new if c in older]:
            memo[c] = older[c]
            new.discard(c)
        new = list(new)
        for lo in range(0, len(new), JOINED):
            some = new[lo : lo + JOINED]
            memo.update(zip(some, self._each(some)))
        found = memo.__getitem__
        return [self._direct(t) if s is None else b"".join(map(found, s)) for t, s in zip(texts, split)]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Output:
    """A file that shows up under its name only when complete."""

    def __init__(self, uri: str):
        if uri.startswith("file:"):
            self.fs, self.path = None, re.sub("^file:(//)?", "", uri)
            os.makedirs(os.path.dirname(self.path), exist_ok=True)
        else:
            self.fs, self.path = _filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.fs.open_output_stream(self.temp) if self.fs else open(self.temp, "wb")  # noqa: SIM115

    def close(self) -> None:
        self.file.close()
        if self.fs:
            self.fs.move(self.temp, self.path)
        else:
            os.replace(self.temp, self.path)


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file's numbers: memory-mapped where the folder is mounted, else read once."""
    if uri.startswith("file:"):
        path = re.sub("^file:(//)?", "", uri)
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)
    fs, path = _filesystem(uri)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Encodes ``docs`` into token files below ``folder`` and returns the manifest.

    The manifest has a row for each partition with documents: ``part, uri, dtype, docs, tokens, base``.  Every row of
    ``docs`` becomes one document ending in ``end_id``.  Null texts count as empty; null ids come first; rows with equal ids
    stay next to each other, ordered by text.  Extra columns are ignored.
    """

    def run(batches):
        part, outs, null, docs_, at = TaskContext.get().partitionId(), None, 0, 0, 0
        enc = encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        for b in batches:
            if not b.num_rows:
                continue
            if outs is None:
                uri = f"{folder}/{part:06d}"
                outs = [_Output(f"{uri}.{x}") for x in ("tok", "off")]
                outs[1].file.write(np.zeros(1, "<u8").tobytes())
                ids = []
            for lo in range(0, b.num_rows, 256):
                c = b.slice(lo, 256)
                coded = enc([t or "" for t in c.column(1).to_pylist()])
                outs[0].file.write(b"".join([x for y in coded for x in (y, end)]))
                stops = at + np.cumsum([len(y) // enc.dtype.itemsize + 1 for y in coded])
                at = int(stops[-1])
                outs[1].file.write(stops.astype("<u8").tobytes())
            null += b.column(0).null_count
            docs_ += b.num_rows
            ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if outs:
            outs.append(_Output(f"{uri}.doc"))
            outs[2].file.write(np.concatenate([np.asarray([null], "<i8"), *ids]).tobytes())
            for o in outs:
                o.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "uri": [uri], "dtype": [enc.dtype.str], "docs": [docs_], "tokens": [at]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(partitions or width(docs.sparkSession), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    manifest = stored(rows.mapInArrow(run, "part int, uri string, dtype string, docs bigint, tokens bigint"), "manifest")
    # One row for each file set: the prefix sum over them fits any task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return stored(manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read back from the files.

    ``start`` counts the ids of all documents before it; the CRC is over the ids as little-endian 32-bit integers.
    """

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                tok, off, doc = (mapped(f"{r['uri']}.{x}", t) for x, t in (("tok", r["dtype"]), ("off", "<u8"), ("doc", "<i8")))
                if len(tok) != r["tokens"] or len(off) != r["docs"] + 1 or len(doc) != r["docs"] + 1:
                    raise ValueError(f"{r['uri']} doesn't hold what the manifest says")
                off = off.astype(np.int64)
                null = int(doc[0])
                for lo in range(0, r["docs"], 4096):
                    hi = min(lo + 4096, r["docs"])
                    crc = [zlib.crc32(tok[off[i] : off[i + 1]].astype("<u4").tobytes()) for i in range(lo, hi)]
                    ids = pa.array(np.asarray(doc[lo + 1 : hi + 1], np.int64), mask=np.arange(lo, hi) < null)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(off[lo:hi] + r["base"]), pa.array(np.diff(off[lo : hi + 1])), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.repartition(max(1, width(manifest.sparkSession)), "part")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as token files in a new shared folder and reads them back."""
    return read_tokens(write_tokens(docs, scratch(spark, "tokens"), tokenizer, end_id))
