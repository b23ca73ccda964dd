"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most four bits exactly if some 64-bit value lies within two bits of both.
So every fingerprint emits the values within half the radius, and equal values bring fingerprints together.
Whatever meets at one value is within four bits of each other, so a group is a clique: linking each member to
the smallest one keeps every connection without emitting pairs, and needs no pass over candidate pairs.  A group
holds at most 1 + 64 + 2016 distinct fingerprints, however many documents carry them.

The full ball has 2,081 values.  A lossless first step keeps it small: of the 64 bits in three blocks, some two blocks
hold at most two of four differing bits, so the two fingerprints meet in those 42 or 43 bits' own ball of radius one.  A
fingerprint that meets no other there is done.  Few that meet are verified in place, and a pair's link is
emitted on one of its keys.  Where many meet, each emits the rest of the ball from there: the flips that remain, in the block
left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, discard, release, stored, width
from .similar import near, rarest

_SLICE = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a whole text: a bit is set if over half of the shingles' XXH64 (seed 42) have it set.

    A-Z are lowered, words are split at six ASCII blanks.  Fewer words than a shingle: the whole sequence is the
    one shingle.  No words (null, empty or blank text): 0.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    n = max(1, len(parts) - words + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[min(words, len(parts)) - 1 :])), np.uint64, n)
    set_ = sum(np.unpackbits(hashes[i : i + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) for i in range(0, n, _SLICE))
    return int(np.packbits(set_ * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp bigint)`` for every row; map-only, one Arrow batch at a time."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


#: The three blocks that are left out in turn: first bit, bits.
_BLOCKS = ((0, 22), (22, 21), (43, 21))
_INSIDE = [((1 << 64) - 1) & ~(((1 << bits) - 1) << at) for at, bits in _BLOCKS]
#: Up to so many fingerprints on a key are compared in place, each with those before it; more emit the rest of the ball.
FRAME = 256


def _bits(x: int):
    """A column of 64 constant bits."""
    x &= (1 << 64) - 1
    return F.lit(str(x - (1 << 64) if x >> 63 else x)).cast("bigint")


def _flips(bits: int, most: int) -> list[int]:
    return [sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)]


def _entry(table: int, mask: int):
    key = lambda m: F.col("fp").bitwiseXOR(m).bitwiseAND(_bits(mask))
    return lambda m: F.struct(F.lit(table).alias("table"), key(m).alias("key"), F.when(m == 0, 2).otherwise(1).alias("left"))


def meetings(fps: DataFrame) -> DataFrame:
    """The distinct ``fps(fp)`` on the variants where they meet others: ``(fp, table, key, left, n, b, before, linked)``.

    Two fingerprints within four bits meet on some key.  ``left`` is the number of flips that the ball has left there and ``n``
    counts a key's fingerprints; ``b`` is their smallest, ``before`` the next smaller one.  ``linked`` has
    the smaller ones within four bits, on one key of all on which a pair meets; null where more than ``FRAME`` meet.
    """
    fp, tables = F.col("fp"), []
    for n, mask in enumerate(_INSIDE):
        flips = F.array(*[_bits(1 << i) for i in range(64) if mask >> i & 1] + [_bits(0)])
        tables.append(F.transform(flips, _entry(n, mask)))
    spread = fps.repartition(width(fps.sparkSession), "fp")
    keyed = spread.select("fp", F.explode(F.concat(*tables)).alias("k")).select("fp", "k.*")
    # Bounded by how many fingerprints fit around one value, not by the number of documents.
    group = Window.partitionBy("table", "key")
    met = keyed.withColumn("n", F.count("*").over(group)).where("n > 1")
    order = group.orderBy("fp")
    met = met.withColumns({"b": F.min("fp").over(group), "before": F.lag("fp").over(order), "smaller": F.collect_list("fp").over(order.rowsBetween(1 - FRAME, -1))})
    inside = F.array(*[_bits(m) for m in _INSIDE])

    def once(y):
        """The links of a pair on its first table; there, on the key without a flip of the larger one or on the lesser of two keys."""
        apart = fp.bitwiseXOR(y)
        within = [F.bit_count(apart.bitwiseAND(_bits(m))) for m in _INSIDE]
        first = F.when(within[0] <= 2, 0).when(within[1] <= 2, 1).otherwise(2)
        here = apart.bitwiseAND(inside[F.col("table")])
        key = F.when(F.bit_count(here) < 2, F.col("left") == 2).otherwise((F.col("left") == 1) & (F.col("key") < F.col("key").bitwiseXOR(here)))
        return (F.bit_count(apart) <= 4) & (first == F.col("table")) & key

    met = met.withColumn("linked", F.when(F.col("n") <= FRAME, F.filter("smaller", once))).drop("smaller")
    return stored(met, "simhash-met")


def links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect all of the distinct ``fps(fp)`` within four bits of each other."""
    fp, met = F.col("fp"), meetings(fps)
    direct = met.where("size(linked) > 0").select(fp.alias("a"), F.explode("linked").alias("b"))
    rest = F.array(*[F.array(*[F.array(*[_bits(m << at) for m in _flips(bits, most)]) for most in (1, 2)]) for at, bits in _BLOCKS])
    outside = F.array(*[_bits(~m) for m in _INSIDE])
    crowded = met.where("linked is null").select("fp", F.col("key").bitwiseOR(fp.bitwiseAND(outside[F.col("table")])).alias("v"), F.explode(rest[F.col("table")][F.col("left") - 1]).alias("m"))
    ball = crowded.select("fp", F.col("v").bitwiseXOR(F.col("m")).alias("v"))
    # A value's group is bounded by the ball's own size, so its smallest fingerprint needs no join.
    led = ball.withColumn("b", F.min("fp").over(Window.partitionBy("v"))).where("fp <> b")
    return direct.union(led.select(fp.alias("a"), "b")).distinct()


def _grouped(each: DataFrame, id_col: str) -> DataFrame:
    """``each(id_col, fp, ...)`` with ``component_id``."""
    distinct = stored(each.groupBy("fp").agg(F.min(id_col).alias("rep")), "simhash-distinct")
    tree = components(links(distinct.select("fp")))
    release(each.sparkSession)
    rooted = stored(distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")), "simhash-root")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    groups = stored(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "simhash-groups")
    return each.join(groups, "fp")


def simhash_groups(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``: groups linked at four or fewer differing bits.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id reachable over links, itself
    included.  Rows without words (null, empty, blank) have fingerprint zero and link like any other.  Repeated rows
    each return one row; a null id takes part, but is a group's ``component_id`` only if all of its ids are null.
    Extra columns are ignored.  An empty table returns no rows.
    """
    each = stored(fingerprints(docs, words, id_col, text_col), "simhash-fp")
    return _grouped(each, id_col).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles_of(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles; A-Z are lowered, fewer words than a shingle are one of all."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, ends, at = b" ".join(parts), [], -1
    for p in parts:
        at += len(p) + 1
        ends.append(at)
    n = max(1, len(parts) - shingle + 1)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts, ends[min(shingle, len(parts)) - 1 :] or [0])), np.uint64, n).view(np.int64))


def _address(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fingerprint_pairs(each: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, ``a > b``, of the nodes of ``each(node, fp)`` that their fingerprints link at four or fewer differing bits.

    A node pairs with the first of its own fingerprint, and that one with the first of the smallest fingerprint that ``links`` joins to
    it, so there are at most two pairs for a node, however many meet.
    """
    first = stored(each.groupBy("fp").agg(F.min("node").alias("first")), "simhash-distinct")
    linked = links(first.select("fp")).select(F.greatest("a", "b").alias("fp"), F.least("a", "b").alias("to")).groupBy("fp").agg(F.min("to").alias("to"))
    across = linked.join(first, "fp").select(F.col("first").alias("x"), F.col("to").alias("fp")).join(first, "fp").select("x", F.col("first").alias("y"))
    same = each.join(first, "fp").where("node <> first").select("node", "first")
    pairs = stored(across.union(same).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "texts-alike")
    discard(first)
    release(each.sparkSession)
    return pairs


def text_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, h, class_id, kept)`` for every row: near copies, linked at a Jaccard coefficient of ``similarity`` or more.

    The coefficient is over sets of ``shingle``-word shingles of the lowered text (fewer words: one of all); a null text is empty, and
    texts without words are alike.  Equal texts are one member.  Fingerprints within four bits give the first pairs, which are verified
    on whole sets.  They miss copies with more edits; those meet by the prefix filter: two sets that are this similar share one of their
    rarest shingles (as many as a partner may lack, and one), and whatever meets within the bounds of length and position, and isn't in
    one class already, is verified too.  First each goes with the member of fewest shingles of its own; then members of a
    shingle that are in different classes by now are compared, if lengths and places let them be similar.  ``h`` is the MD5 of the text, ``class_id`` the smallest id of the
    class, ``kept`` true for its smallest ``(id, h)``.  Rows with a null id are not returned.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), _address(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def sketch(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                of = [t.as_py() for t in c.column(1)]
                columns = [pa.array([shingles_of(t, shingle) for t in of], pa.list_(pa.int64())), pa.array(np.array([fingerprint(t) for t in of], np.uint64).view(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays([c.column(0), *columns], ["h", "s", "fp"])

    texts = rows.groupBy("h").agg(F.first("text").alias("text"))
    sets = stored(texts.mapInArrow(sketch, "h binary, s array<bigint>, fp bigint").select(F.monotonically_increasing_id().alias("node"), "h", "s", "fp"), "texts-sets")
    release(docs.sparkSession)
    alike = fingerprint_pairs(sets.select("node", "fp"))
    each = stored(rows.select("id", "h").join(sets.select("h", "node").hint("merge"), "h"), "texts-rows")
    index = rarest(sets, similarity)
    tree = near(index, sets, similarity, alike)
    rooted = stored(each.join(tree, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root")), "texts-classes")
    least = rooted.groupBy("root").agg(F.min(F.struct("id", "h")).alias("top"))
    found = rooted.join(least, "root").select(F.col("id").alias(id_col), "h", F.col("top.id").alias("class_id"), (F.struct("id", "h") == F.col("top")).alias("kept"))
    found = stored(found, "texts-found")
    discard(each, index, rooted)
    release(docs.sparkSession)
    return found


def near_duplicates_removed(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, same columns, with one row of each class of near copies: one with the class's smallest id.

    Of several rows with that id in a class one stays.  Rows with a null id all stay, since nothing tells them apart.  An empty
    table returns no rows.
    """
    found = text_classes(docs, similarity, shingle, id_col, text_col)
    of = lambda t: (docs[id_col] == t["_id"]) & (_address(docs[text_col]) == t["_h"])
    gone = found.where("not kept").select(F.col(id_col).alias("_id"), F.col("h").alias("_h")).distinct()
    left = docs.join(gone.hint("merge"), of(gone), "left_anti")
    again = found.where("kept").groupBy(F.col(id_col).alias("_id"), F.col("h").alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_id", "_h")
    if again.isEmpty():
        return left
    again = checkpointed(again)
    return left.join(again, of(again), "left_anti").unionByName(left.join(again, of(again), "left_semi").dropDuplicates([id_col, text_col]))
