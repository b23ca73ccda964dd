"""SpotSigs document fingerprints: chains of content words that follow common words.

A common word is an anchor; with the next two content words after it, it makes a signature.  Running text is full of
anchors, listings and page furniture aren't, so a document's set of signatures is its prose.  Likeness is the
Jaccard coefficient of two sets.  A set of length m reaches likeness t only with sets from t*m to m/t, so sets are dealt
into length classes whose bounds grow by 1/t, and a set meets only its own class and the next one up.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, discard, range_bounds, stored, width
from .similar import near, rarest

#: Anchors of English, French, German and Spanish.
ANCHORS = frozenset(
    """
    a an and are as at be been but by can could did do does for from had has have he her his how i if in into is it its
    more most my no not of on one or our out said she should so some than that the their them then there these they this
    to up was we were what when where which while who will with would you your
    au aux avec ce ces cette comme dans de des donc du elle elles en est et eux il ils je la le les leur lui ma mais
    me même mes moi ne nos notre nous on ou où par pas pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une
    vos votre vous
    aber als am auch auf aus bei bin bis das daß dass dem den der des die durch ein eine einem einen einer eines er es
    für hat hatte ich ihr im ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor
    war was wenn werden wie wird wir zu zum zur
    al ante como con contra cual cuando del desde donde dos el ella ellas ellos entre era eran es esa ese eso esta este
    esto fue ha hasta hay la las le les lo los más mi mis muy nada ni no nos o os otra otro para pero por que quien se ser si
    sin sobre su sus también te tiene todo tu un una unas uno unos y ya yo
    """.split()
)
CHAIN = 2
_WORD = re.compile(r"[^\W_]+")


def signatures(text: str) -> np.ndarray:
    """The sorted distinct 32-bit signatures of a whole text.

    Letters are lowered; words are runs of letters and digits.  A text whose anchors start no chain has one signature,
    of all its words; a text without words has none.  A chain at the text's end may be one word long.
    """
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint32)
    content, spots = [], []
    for w in words:
        if w in ANCHORS:
            spots.append((len(content), w))
        else:
            content.append(w)
    n = len(content)
    made = {f"{w} {' '.join(content[i : i + CHAIN])}" for i, w in spots if i < n} or {" ".join(words)}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(x) for x in made), np.uint32, len(made)))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """The Jaccard coefficient of two sorted sets, or 0 as soon as their lengths rule out ``least``.  Two empty sets: 1."""
    short, long = sorted((len(a), len(b)))
    if not long:
        return 1.0
    if not short or short < least * long:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (short + long - both)
    return found if found >= least else 0.0


def hexed(found: np.ndarray) -> str:
    """Eight hex digits for each signature, in order."""
    return found.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> str:
    return hexed(signatures(text or ""))


def length_class(n: int, threshold: float) -> int:
    """0 for an empty set; a class's longest set is under 1/threshold times its shortest."""
    return 0 if n < 1 else 1 + int(math.floor(math.log(n) / -math.log(threshold) + 1e-9))


def next_in_order(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` dealt into ranges of descending ids, each followed by the first row of the range below.

    Adds ``bucket``, ``h`` (a hash of the text, the order of equal ids) and ``lead`` (true for the row lent by the next range;
    the lowest range borrows the very first row).  Partitions hold whole ranges in order, so a streaming pass over one
    sees each document and then its successor.  Only a row's key for each range reaches the driver.
    """
    spark, n = docs.sparkSession, width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    bounds = range_bounds(rows.select("doc_id"), "doc_id", n)
    rows = rows.withColumn("bucket", bucket_of(F.col("doc_id"), bounds))
    heads = [(r["bucket"], r["top"][0], r["top"][1]) for r in sorted(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "h")).alias("top")).collect())]
    lent = [(heads[i - 1][1], heads[i - 1][2], heads[i][0]) for i in range(len(heads))]
    lent = spark.createDataFrame(lent, "_id bigint, _h bigint, _to int")
    own = rows.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    places = F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lead")), F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("lead")))
    own = own.select("doc_id", "h", "text", F.explode(F.when(F.col("_to").isNull(), F.slice(places, 1, 1)).otherwise(places)).alias("p")).select("doc_id", "h", "text", "p.*")
    # Ranges are partitions: hashed, some tasks would have several of them.
    return own.repartitionById(n + 1, "bucket").sortWithinPartitions("bucket", "lead", F.col("doc_id").desc_nulls_last(), F.col("h").desc())


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures int, length_class int"


def edited_likeness(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Each document's fingerprint, and its likeness to an edited copy and to the next document.

    The edited text has the last third of the code points (rounded down) replaced by the first as many, or all, of the next
    document in descending id order; after the last comes the first.  Null texts are empty.  A null id follows all
    others; equal ids follow each other by a hash of the text.  A single row is its own next one.  Extra columns are
    ignored; an empty table returns no rows.
    """
    names = [x.split()[0] for x in _OUT.split(", ")]
    types = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}[x.split()[1]]) for n, x in zip(names, _OUT.split(", "))])

    def run(batches):
        held = None  # the row whose successor comes next: bucket, id, text, signatures
        for b in batches:
            out = []
            for doc_id, text, bucket, lead in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "lead"))):
                if held is None and lead:
                    continue
                own = signatures(text)
                if held is not None:
                    _, i, t, s = held
                    k = len(t) // 3
                    edited = t[: len(t) - k] + text[:k]
                    e = signatures(edited)
                    out.append((i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), hexed(s), hexed(e), likeness(s, e), likeness(s, own), len(s), length_class(len(s), threshold)))
                held = None if lead else (bucket, doc_id, text, own)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)

    return next_in_order(docs).mapInArrow(run, _OUT)


def spot_groups(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, class_id)`` for every row: groups linked at likeness ``threshold`` or more.

    Equal sets are one member however many rows have them.  A set's rarest signatures, as many as a partner must share one of, are
    its index entries; entries meet on signature and on the lower of two adjacent length classes, and what meets within the bounds
    of length is compared by the exact coefficient (see ``similar``).  ``class_id`` is the smallest id of the group, null if all
    are.  Null texts are empty, and rows without words are one class.  Equal rows each return one; an empty table returns no rows.
    """

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                sets = [signatures(t.as_py() or "").astype(np.int64) for t in c.column(1)]
                address = pa.array([hashlib.md5(s.tobytes()).digest() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([c.column(0), address, pa.array(sets, pa.list_(pa.int64()))], ["id", "h", "s"])

    kind = docs.schema[id_col].dataType.simpleString()
    each = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, h binary, s array<bigint>")
    each = stored(each, "spots")
    sets = each.groupBy("h").agg(F.first("s").alias("s")).select(F.monotonically_increasing_id().alias("node"), "h", "s")
    sets = stored(sets, "spot-sets")
    members = stored(each.groupBy("h").agg(F.min("id").alias("rep")).join(sets.select("h", "node").hint("merge"), "h"), "spot-members")
    index = rarest(sets.where(F.size("s") > 0), threshold)
    level = F.floor(F.log("n") / -math.log(threshold) + 1e-9)
    dealt = index.withColumn("level", F.explode(F.array(level, level - 1))).withColumn("token", F.xxhash64("token", "level")).drop("level")
    tree = near(dealt, sets, threshold)
    rooted = stored(members.join(tree, "node", "left").select("h", "rep", F.coalesce("root", "node").alias("root")), "spot-roots")
    least = rooted.groupBy("root").agg(F.min("rep").alias("class_id"))
    final = stored(rooted.join(least, "root").select("h", "class_id"), "spot-classes")
    rows = stored(each.select("id", "h").join(final.hint("merge"), "h").select(F.col("id").alias(id_col), "class_id"), "spot-rows")
    discard(each, members, index, rooted, final)
    return rows
