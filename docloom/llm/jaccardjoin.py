"""N-gram Jaccard join by grouped prefixes: which documents' shingle sets overlap in ``percent`` of their union or more.

Under one order of all shingles, two sets that are so similar have their first shared shingle among the first
``n - ceil(percent * n) + 1`` of either: the prefix.  The order is by how often a shingle's bucket, of a fixed number, is hit by all
sets, so common passages come last; any order loses nothing.  Sets with equal size and prefix collapse into one group, and
the index holds the groups' prefixes.  Groups that meet on a shingle within the bounds of size and place are compared in three steps:

1. each group with one leader on each of its shingles, and each member with the first of its group;
2. what isn't in one class by now, one member for each class in a group;
3. group pairs that are still apart are expanded to their members.

A pair is dropped if the parities of its sets' buckets differ in more places than the sets may, which needs no sets, and else
verified on whole sets.  A pair within the threshold is in one class after some step, so none is lost, and copies are never
expanded into all pairs.

Whole sets are twice as large as compressed texts and are never stored for all rows: they are made from the texts for the counts, for
the prefixes, and again for the pairs to verify.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, release, stored

#: The index, and texts that can't stay where they are, are moved in so many turns, which bounds what lies on disk at a time.
TURNS = 4
#: Up to so many rows (8 MB for each column) a list of nodes is broadcast, and what it picks stays where it is.
BROADCAST_ROWS = 1_000_000
#: Rows of a batch that goes to Python: whole sets are wide.
BATCH = 1000
#: Buckets whose counts give the order: 8 MB at most, at any size of the corpus.  A parity bit for each of so many other buckets at least.
BUCKETS, PARITIES = 1 << 20, 1024
_STEP, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's shingles; A-Z are lowered, words are split at six ASCII blanks.

    Fewer words than a shingle are one shingle of all; without words there is none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    each = np.fromiter(map(_HASHES.__getitem__, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    n = len(parts) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h + each[k : k + n]) * _STEP
        h ^= h >> np.uint64(32)
    h *= _LAST
    return np.unique((h ^ h >> np.uint64(29)).view(np.int64))


def _digest(s: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return hashlib.md5(s.tobytes()).digest()


def parities(s: np.ndarray) -> np.ndarray:
    """A bit for each bucket of a set: whether it holds an odd number of shingles; 64 to a number.

    There are half as many buckets as shingles at least, else the bits of two long sets couldn't differ in more places than the sets may.
    """
    size = max(PARITIES, 1 << (max(1, len(s) // 2) - 1).bit_length())
    return np.packbits((np.bincount(s >> 32 & (size - 1), minlength=size) & 1).astype(np.uint8)).view(np.int64)


def apart(p, q):
    """In how many places two columns of parities differ; the longer is folded to the buckets of the shorter."""
    fold = lambda x, y: F.transform(F.sequence(F.lit(1), F.size(y)), lambda i: F.aggregate(F.sequence(i, F.size(x), F.size(y)), F.lit(0).cast("bigint"), lambda a, j: a.bitwiseXOR(F.element_at(x, j))))
    even = lambda x, y: F.when(F.size(x) > F.size(y), fold(x, y)).otherwise(x)
    return F.aggregate(F.zip_with(even(p, q), even(q, p), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)


def bucket_counts(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of ``texts(text)`` fall into each of ``BUCKETS`` buckets; counted by each task and added by ranges of buckets.

    A task counts equal sets once.
    """
    ranges = 64
    size = BUCKETS // ranges

    def counted(batches):
        total = np.zeros(BUCKETS, np.int64)
        seen: set[bytes] = set()
        for b in batches:
            for t in b.column(0):
                s = shingles(t.as_py(), words)
                if (digest := _digest(s)) not in seen:
                    seen.add(digest)
                    np.add.at(total, s & (BUCKETS - 1), 1)
        kind = np.min_scalar_type(total.max())
        yield pa.RecordBatch.from_arrays([pa.array(range(ranges), pa.int32()), pa.array([kind.str] * ranges), pa.array([x.tobytes() for x in total.astype(kind).reshape(ranges, size)], pa.binary())], ["at", "kind", "counts"])

    def added(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, kind, counts in zip(*(c.to_pylist() for c in b.columns)):
                total[at] = total.get(at, 0) + np.frombuffer(counts, kind).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(["<i8"] * len(total)), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["at", "kind", "counts"])

    kind = "at int, kind string, counts binary"
    found = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(counted, kind).repartition(ranges, "at").mapInArrow(added, kind).collect():
        found[r["at"] * size : (r["at"] + 1) * size] = np.frombuffer(r["counts"], "<i8")
    return found


def _sketched(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """``(node, id, row, digest, n, tokens, key, parity)`` of ``rows(id, text, row)``, stored.

    The digest is of the whole set, the tokens are its prefix in order, the key is a digest of size and prefix.  Of a set that the task
    has had already the last three are null, so that copies are listed once for each task, not once each.
    """
    often = bucket_counts(rows, words)
    often = often.astype(np.min_scalar_type(often.max()))

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c = b.slice(lo, 512)
                digests, sizes, lists, keys, parity = [], [], [], [], []
                for t in c.column(1):
                    s = shingles(t.as_py(), words)
                    n, digest = len(s), _digest(s)
                    digests.append(digest)
                    sizes.append(n)
                    if digest in seen or not n:
                        lists.append(None)
                        keys.append(None)
                        parity.append(None)
                        continue
                    seen.add(digest)
                    places = n - (n * percent + 99) // 100 + 1
                    first = s[np.argsort(often[s & (BUCKETS - 1)], kind="stable")[:places]]
                    lists.append(first)
                    keys.append(hashlib.md5(n.to_bytes(8, "little") + first.tobytes()).digest())
                    parity.append(parities(s))
                columns = [pa.array(x, t) for x, t in zip((digests, sizes, lists, keys, parity), (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(2), *columns], ["id", "row", "digest", "n", "tokens", "key", "parity"])

    kind = f"id {rows.schema['id'].dataType.simpleString()}, row bigint, digest binary, n bigint, tokens array<bigint>, key binary, parity array<bigint>"
    found = rows.select("id", "text", "row").mapInArrow(run, kind)
    return stored(found.select(F.monotonically_increasing_id().alias("node"), "*"), "join-prefixes")


def _whole(rows: DataFrame, words: int) -> DataFrame:
    """``(digest, s)``: the whole sets of ``rows(text)``, equal ones once for each task."""

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                digests, sets = [], []
                for t in b.column(0).slice(lo, 128):
                    s = shingles(t.as_py(), words)
                    if (digest := _digest(s)) not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        sets.append(s)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "s"])

    return rows.select("text").mapInArrow(run, "digest binary, s array<bigint>")


def _at_hand(listed: DataFrame) -> DataFrame:
    """A stored list for a join: broadcast while it is short."""
    return F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed


def _pairs(x: str, y: str):
    return F.struct(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))


def _verified(pairs: DataFrame, rows: DataFrame, sketch: DataFrame, percent: int, words: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets overlap in ``percent`` of their union or more; sets are made of their ``rows`` only."""
    ends = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "join-ends")
    sketch = sketch.join(_at_hand(ends), "node", "left_semi")
    of = lambda x: sketch.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "parity", "row", "digest")))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    open_ = both.where(sizes & ((100 + percent) * apart(F.col("paritya"), F.col("parityb")) <= (100 - percent) * (F.col("na") + F.col("nb")))).drop("paritya", "parityb")
    open_ = stored(open_, "join-open")
    discard(ends)
    made = [open_]

    def side(x: str) -> DataFrame:
        """The sets on one side of the pairs."""
        wanted = stored(open_.select(F.col(f"row{x}").alias("row")).distinct(), "join-wanted")
        made.append(wanted)
        if wanted.count() <= BROADCAST_ROWS:
            found = _whole(rows.join(F.broadcast(wanted), "row", "left_semi"), words)
        else:
            parts = []
            for turn in range(TURNS):
                mine = F.pmod("row", F.lit(TURNS)) == turn
                parts.append(stored(_whole(rows.where(mine).join(wanted.where(mine), "row", "left_semi"), words), "join-needed"))
                release(rows.sparkSession)
            made.extend(parts)
            found = functools.reduce(DataFrame.unionByName, parts)
        return found.select(F.col("digest").alias(f"digest{x}"), F.col("s").alias(f"s{x}"))

    both = open_.drop("rowa", "rowb").join(side("a"), "digesta").join(side("b"), "digestb")
    shared = F.size(F.array_intersect("sa", "sb"))
    found = stored(both.where((100 + percent) * shared >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct(), "join-links")
    discard(*made)
    release(rows.sparkSession)
    return found


def similar_classes(rows: DataFrame, lists: DataFrame, distinct: DataFrame, percent: int, words: int) -> DataFrame:
    """Components ``(node, root)`` of all pairs of ``lists``, made of ``rows``, whose sets' overlap is ``percent`` of their union or more.

    Only the nodes in ``distinct(node)`` take part.
    """
    lists = lists.where("tokens is not null")
    sketch = lists.select("node", "n", "parity", "row", "digest")
    keyed = stored(lists.select("node", "key").join(distinct, "node", "left_semi"), "join-keys")
    groups = stored(keyed.groupBy("key").agg(F.min("node").alias("g")), "join-groups")
    members = stored(keyed.join(groups, "key").select("g", "node"), "join-members")
    # Nearly all nodes are the first of their group, so the others' list is short and prefixes stay where they are.
    firsts = groups.select(F.col("g").alias("node"))
    others = stored(lists.select("node").join(firsts, "node", "left_anti"), "join-others")
    if others.count() <= BROADCAST_ROWS:
        first, kept = lists.select("node", "n", "tokens").join(F.broadcast(others), "node", "left_anti"), [others]
    else:
        first = stored(lists.select("node", "n", "tokens").join(firsts, "node", "left_semi"), "join-first")
        kept = [others, first]
    # Size and place go through the shuffle as one number.  A shingle's leader is its first group, the same on most shingles of a class.
    index, turns = first.select(F.posexplode("tokens").alias("at", "token"), F.col("node").alias("g"), "n").select("token", "g", F.expr("shiftleft(n, 32) | at").alias("place")), []
    place = [F.expr("shiftright(place, 32)").alias("n"), F.expr("place & 4294967295L").alias("at")]
    for turn in range(TURNS):
        mine = index.where(F.pmod("token", F.lit(TURNS)) == turn)
        often = stored(mine.groupBy("token").agg(F.count("*").alias("many"), F.min("g").alias("lead")).where("many > 1"), "join-often")
        turns.append(stored(mine.join(often, "token").select("token", "lead", F.struct("g", *place).alias("x")), "join-index"))
        discard(often)
        release(rows.sparkSession)
    discard(*kept)
    index = functools.reduce(DataFrame.unionByName, turns)

    def near(a, b):
        """Sizes, and the shingles that remain if this is the first shared one, allow the overlap."""
        sizes = a["n"] + b["n"]
        return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & ((100 + percent) * F.least(a["n"] - a["at"], b["n"] - b["at"]) >= percent * sizes)

    star = index.where("x.g <> lead").select(_pairs("x.g", "lead").alias("p"))
    inside = members.where("g <> node").select(_pairs("g", "node").alias("p"))
    pairs = stored(star.union(inside).select("p.*").distinct(), "join-pairs")
    links = [_verified(pairs, rows, sketch, percent, words)]

    def classes():
        """``(g, node, c)``: members with their class by the links so far."""
        tree = components(functools.reduce(DataFrame.union, links))
        return members.join(tree, "node", "left").select("g", "node", F.coalesce("root", "node").alias("c"))

    now = stored(classes(), "join-classes")
    parts = stored(now.groupBy("g", "c").agg(F.min("node").alias("rep")), "join-parts")
    # Most groups have one class, of their own; the others' list is short.
    moved = stored(parts.join(parts.where("g <> c or g <> rep").select("g").distinct(), "g", "left_semi"), "join-moved")
    lead = stored(now.where("g = node and g <> c").select(F.col("g").alias("lead"), F.col("c").alias("leading")), "join-leading")
    met = index.select("token", "lead", "x", F.col("x.g").alias("g")).join(_at_hand(moved), "g", "left").join(_at_hand(lead), "lead", "left")
    met = met.select("token", F.coalesce("leading", "lead").alias("leading"), F.struct("x.*", F.coalesce("c", "g").alias("c"), F.coalesce("rep", "g").alias("rep")).alias("x"))
    met = stored(met, "join-met")
    open_ = met.where("x.c <> leading")
    unlike = stored(open_.select("token").distinct(), "join-unlike")
    across = open_.select("token", "x").join(met.join(_at_hand(unlike), "token", "left_semi").select("token", "leading", F.col("x").alias("y")), "token")
    across = across.where("x.c <> y.c and (y.c = leading or x.c < y.c)").where(near(F.col("x"), F.col("y")))
    part = lambda p: F.struct(f"{p}.g", f"{p}.c", f"{p}.rep")
    across = across.select(F.greatest(part("x"), part("y")).alias("p"), F.least(part("x"), part("y")).alias("q"))
    # Within a group, classes meet the class of its first member and each other.
    own = parts.join(parts.where("g = rep").select("g", F.col("c").alias("lead")), "g").select("lead", F.struct("g", "c", "rep").alias("p"))
    within = own.where("p.c <> lead").select("p", F.col("p.g").alias("g")).join(own.select(F.col("p").alias("q"), "lead", F.col("p.g").alias("g")), "g").where("p.c <> q.c and (q.c = lead or p.c < q.c)")
    unsure = stored(across.union(within.select(F.greatest("p", "q"), F.least("p", "q"))).distinct(), "join-apart")
    reps = unsure.select(_pairs("p.rep", "q.rep").alias("r")).select("r.*").distinct()
    fresh = stored(reps.join(pairs, ["a", "b"], "left_anti"), "join-fresh")
    links.append(_verified(fresh, rows, sketch, percent, words))

    # A part is a group's members of one class of the first step; what the second has linked needs no expansion.
    then = stored(now.select("g", F.col("c").alias("was"), "node").join(classes().select("node", "c"), "node"), "join-classes-then")
    side = lambda p: then.select(F.col("g").alias(f"{p}g"), F.col("was").alias(f"{p}was"), F.col("node").alias(f"{p}node"), F.col("c").alias(f"{p}c"))
    expanded = unsure.select(F.col("p.g").alias("pg"), F.col("p.c").alias("pwas"), F.col("q.g").alias("qg"), F.col("q.c").alias("qwas")).join(side("p"), ["pg", "pwas"]).join(side("q"), ["qg", "qwas"])
    expanded = expanded.where("pc <> qc").select(_pairs("pnode", "qnode").alias("r")).select("r.*").distinct()
    rest = stored(expanded.join(pairs.union(reps), ["a", "b"], "left_anti"), "join-rest")
    links.append(_verified(rest, rows, sketch, percent, words))
    tree = components(functools.reduce(DataFrame.union, links))
    discard(keyed, groups, members, *turns, pairs, now, parts, moved, lead, met, unlike, unsure, fresh, then, rest, *links)
    return tree


def jaccard_groups(docs: DataFrame, percent: int = 85, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for every row: sets of ``words``-word shingles, linked at ``percent`` of the union.

    ``component_id`` is the smallest id reachable over links, itself included.  Null, empty and blank texts have empty sets, which link
    with nothing, not even each other.  Equal texts, and repeated rows, are linked and return a row each.  A null id takes part, but
    is a ``component_id`` only if all ids of the class are null.  Extra columns are ignored.  An empty table returns no rows.
    The table is read several times and has to give the same rows each time.
    """
    spark, rows = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, min(BATCH, int(before)) if int(before) > 0 else BATCH)
    try:
        return _jaccard_groups(docs, percent, words, id_col, text_col)
    finally:
        spark.conf.set(rows, before)


def _jaccard_groups(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("text", "id"))
    lists = _sketched(rows, percent, words)
    each = lists.select("id", "digest", "n")
    distinct = lists.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.min(F.when(F.col("key").isNotNull(), F.col("node"))).alias("node"))
    distinct = stored(distinct, "join-distinct")
    tree = similar_classes(rows, lists, distinct.select("node"), percent, words)
    rooted = stored(distinct.join(tree, "node", "left").select("digest", "rep", F.coalesce("root", "node").alias("root")), "join-rooted")
    least = stored(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "join-class")
    found = stored(rooted.join(least, "root").select("digest", "component_id"), "join-found")
    linked = each.where("n > 0").join(found, "digest").select("id", "n", "component_id")
    alone = each.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    discard(distinct, rooted, least)
    return linked.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
