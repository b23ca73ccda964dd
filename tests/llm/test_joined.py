"""Clustering, ranked search and the Jaccard join, held against brute force on rows with nulls, blanks, ties, repeats and very long texts."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import clusters, jaccardjoin, maxscore
from docloom.llm.clusters import clustered
from docloom.llm.jaccardjoin import jaccard_groups, shingles
from docloom.llm.maxscore import ranked
from docloom.llm.queries import ORACLE_SQL, QUERIES

from .helpers import CLASHING, documents

SF = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "a\t  b\r\nc", "x y 　z", "tab\tand\x1ccontrol", "K 🙂 naïve ſtraße", "word " * 3000]


@pytest.mark.parametrize("name", ["op11_vector_clusters", "op12_benchmark_search", "op13_jaccard_groups"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    assert sorted(d[0] for d in found.description) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*(d[0] for d in found.description)).collect())) == sorted(found.fetchall())


VECTORS = "vec_id bigint, embedding array<float>"


def vectors(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    for name, value in CLASHING.items():
        df = df.withColumn(name, F.lit(value))
    return df.withColumns({"q": F.lit("q"), "n": F.lit(1), "cluster": F.lit(9), "distance": F.lit(9)})


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in order[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        to = [nearest(q)[1] for _, q in kept]
        centroids = [[sum(x) // len(own) for x in zip(*own)] if (own := [q for (_, q), t in zip(kept, to) if t == n]) else c for n, c in enumerate(centroids)]
    last = [(i, *reversed(nearest(q))) for i, q in kept]
    each = Counter()
    for _, c, d in last:
        each[c] += d
    return [(i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in last]


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_clusters(spark, scale):
    """At the larger scale squared distances pass 2^53, and sums still are exact."""
    rnd = random.Random(3)
    f = lambda x: float(np.float32(x * scale))
    rows = [(i, [f(rnd.gauss(i % 3, 0.4)) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, rows[i % 2][1]) for i in range(40)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    rows += [(200, None), (201, []), (202, [f(1)] * 3), (203, [f(1), None, f(1), f(1)]), (204, [f(1), float("nan"), f(1), f(1)]), (205, [float("inf"), f(0), f(0), f(0)]), (206, [-0.0, 0.0, f(-0.001), f(0.001)])]
    got = clustered(vectors(spark, rows), k=5, rounds=3, dims=4)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_clusters(rows, 5, 3, 4), key=str)


def test_clusters_ties_few_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])]
    got = sorted(map(tuple, clustered(vectors(spark, rows), k=16, dims=2).collect()))
    assert got == sorted(brute_clusters(rows, 16, 3, 2))
    assert clustered(vectors(spark, rows), dims=3).collect() == [] and clustered(vectors(spark, []), dims=2).collect() == []


def test_components_beyond_a_long_saturate(spark):
    got = clustered(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [1.0, 1.0])]), k=1, rounds=1, dims=2).collect()
    assert len(got) == 3 and max(r["distance"] for r in got) == max(r["inertia"] for r in got) == (1 << 63) - 1


def test_nearest_is_exact_in_both_types():
    rnd = np.random.default_rng(1)
    for most in (100, 1 << 22, 1 << 40):
        q, c = rnd.integers(-most, most, (50, 64)), rnd.integers(-most, most, (7, 64))
        to, apart = clusters.nearest(q, c)
        for row, n, d in zip(q.tolist(), to, apart):
            assert (int(d), n) == min((sum((a - b) ** 2 for a, b in zip(row, x)), k) for k, x in enumerate(c.tolist()))


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranking(docs, items, k):
    each = [(i, Counter(brute_terms(t))) for i, t in docs]
    N, L = sum(1 for _, c in each if c), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in each:
            if n := sum(c.values()):
                m = 100 - 50 + 50 * n * N // L
                s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(brute_terms(text)) if t in c)
                if s > 0:
                    scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("text", [*ODD, "a_b-c{d}e@f[g]h`i~\x7fj", "AÀÉ9 Z"])
def test_terms(text):
    assert [t.decode() for t in maxscore.terms(text)] == brute_terms(text)


@pytest.mark.parametrize("shard, block", [(4096, 250_000), (7, 250_000), (16, 20)])
def test_ranked(spark, monkeypatch, shard, block):
    """Small shards let thresholds carry over and lists become non-essential; small blocks deal the items out."""
    monkeypatch.setattr(maxscore, "SHARD", shard)
    rnd = random.Random(shard)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 40)))) for i in range(200)]
    docs += [(300 + i, docs[5][1]) for i in range(30)] + [(5, docs[5][1]), (None, docs[5][1])] + [(400 + i, t) for i, t in enumerate(ODD)]
    items = [(i, " ".join(rnd.choices(words, k=12))) for i in range(8)] + [(3, "W1 w2, w3"), (None, "w1 w1 word"), (90, None), (91, "..."), (92, "unheard of")]
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumns({"score": F.lit(1), "doc_id": F.lit(2), "item": F.lit(3)})
    got = ranked(documents(spark, docs, **CLASHING), table, k=9, block_terms=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_ranking(docs, items, 9), key=str)


def test_ranked_probes_only_while_a_document_can_qualify():
    """The common term's list is non-essential once the threshold is high, and its documents aren't candidates."""
    import pyarrow as pa

    lists = pa.array([[0]] * 90 + [[0, 1]] * 10, pa.list_(pa.int32()))
    tfs = pa.array([[1]] * 90 + [[1, 1]] * 10, pa.list_(pa.int32()))
    shard = maxscore.Shard(np.arange(100), np.ones(100, bool), pa.array([2] * 100, pa.int64()), lists, tfs, np.array([10, 3000]), 100, 200)
    places, scores = shard.search(np.array([0, 1]), int(shard.bounds[1]))
    assert places.tolist() == list(range(90, 100)) and set(scores) == {shard.bounds.sum()}
    assert not len(shard.search(np.array([0, 1]), int(shard.bounds.sum()) + 1)[0]) and not shard.scores.any()


def test_ranked_empty(spark):
    items = spark.createDataFrame([(1, "word")], "item_id bigint, text string")
    docs = documents(spark, [(1, "word")])
    for d, i in ((docs.where("doc_id > 1"), items), (docs, items.where("item_id > 1")), (documents(spark, [(1, None), (2, "..")]), items)):
        assert ranked(d, i).collect() == []


def brute_set(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_groups(rows, percent):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in least[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("text", [*ODD, "A b C d E", "a b c d a b c d a"])
def test_shingles(text):
    assert len(shingles(text)) == len(brute_set(text))


def test_a_text_of_three_words_is_no_shingle_of_four():
    assert not set(shingles("a b c").tolist()) & set(shingles("a b c d").tolist())
    assert (shingles("a b c d e") == shingles("d e A b c d\ne a b c d")[np.isin(shingles("d e a b c d e a b c d"), shingles("a b c d e"))]).all()


def family(rnd, words, size, edits):
    """A text and copies that drift away from each other word by word."""
    at, out = rnd.choices(words, k=size), []
    for _ in range(edits):
        at = list(at)
        for _ in range(rnd.randint(0, 2)):
            at[rnd.randrange(len(at))] = rnd.choice(words)
        out.append(" ".join(at))
    return out


@pytest.mark.parametrize("seed, vocabulary, size, buckets", [(1, 400, 90, 1 << 20), (2, 3, 30, 1 << 20), (3, 30, 12, 64), (4, 400, 400, 64)])
def test_jaccard_groups(spark, monkeypatch, seed, vocabulary, size, buckets):
    """Drifting families, shared passages, few words (crowded shingles), copies, ties and odd texts; any order of the shingles will do."""
    monkeypatch.setattr(jaccardjoin, "BUCKETS", buckets)
    monkeypatch.setattr(jaccardjoin, "BROADCAST_ROWS", buckets - 64)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    texts = [t for _ in range(4) for t in family(rnd, words, size, 14)]
    passage = " ".join(rnd.choices(words, k=size))
    texts += [f"{passage} {' '.join(rnd.choices(words, k=rnd.choice([1, 2, 3, 8, size])))}" for _ in range(30)]
    texts += texts[:8] * 2 + [texts[0].upper(), texts[1].replace(" ", "\n\t")] + ODD + ODD[3:5]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[4]), (None, "alone without an id"), (4, "another text of a known id")]
    rnd.shuffle(rows)
    got = jaccard_groups(documents(spark, rows, **CLASHING))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_groups(rows, 85), key=str)


def test_groups_collapse_and_expand(spark):
    """Texts that differ in words of their own only have one prefix group, whether or not they are similar."""
    rnd = random.Random(7)
    common = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(common + [f"own{i}-{k}" for k in range(n)])) for i, n in enumerate([0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 9, 9, 9])]
    rows += [(100 + i, " ".join([*common[:20], f"x{i}", *common[21:]])) for i in range(6)]
    rnd.shuffle(rows)
    assert sorted(map(tuple, jaccard_groups(documents(spark, rows)).collect())) == sorted(brute_groups(rows, 85))


def test_jaccard_empty_tables(spark):
    docs = documents(spark, [(1, None), (2, "")])
    assert jaccard_groups(docs.where("doc_id > 2")).collect() == []
    assert sorted(map(tuple, jaccard_groups(docs).collect())) == [(1, 0, 1), (2, 0, 2)]


def watched(monkeypatch):
    """What the Jaccard join stores: (name, rows, bytes) of each frame."""
    found, keep = [], jaccardjoin.stored

    def stored(df, name):
        out = keep(df, name)
        found.append((name, out.count(), sum(p.stat().st_size for p in Path(out._stored_at.removeprefix("file://")).glob("*.parquet"))))
        return out

    monkeypatch.setattr(jaccardjoin, "stored", stored)
    return found


def test_jaccard_stores_no_sets_of_rows_without_pairs(spark, monkeypatch):
    """Hashes of whole sets don't compress: they take 8 bytes a shingle."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"{rnd.getrandbits(30):x}" for _ in range(2000))) for i in range(40)]
    kept = watched(monkeypatch)
    got = jaccard_groups(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == [(i, 1997, i) for i, _ in rows]
    assert sum(size for _, _, size in kept) < 8 * 40 * 1997


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_long_texts_with_a_shared_half_are_told_apart_without_their_sets(spark, monkeypatch, broadcast):
    monkeypatch.setattr(jaccardjoin, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(6)
    passage = lambda: [f"{rnd.getrandbits(30):x}" for _ in range(5000)]
    shared, u, v = passage(), passage(), passage()
    rows = [(1, shared + u), (2, shared + v), *((10 + i, u + passage()) for i in range(4)), *((20 + i, v + passage()) for i in range(4))]
    # Sizes on both sides of a power of two: parities of 8192 buckets meet ones of 4096.
    near = passage() + passage()[:3300]
    rows += [(30, near[:8100]), (31, near)]
    rows = [(i, " ".join(x)) for i, x in rows]
    kept = watched(monkeypatch)
    got = jaccard_groups(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_groups(rows, 85)) and (31, 8297, 30) in map(tuple, got)
    assert sum(n for name, n, _ in kept if name == "join-pairs") > 1 == sum(n for name, n, _ in kept if name == "join-open")


def test_parities_never_exceed_the_difference(spark):
    rnd = np.random.default_rng(8)
    every = rnd.integers(-(1 << 63), (1 << 63) - 1, 30_000)
    for m, n in ((1, 2), (2040, 2060), (4090, 4110), (100, 20_000), (20_000, 100), (9000, 9000)):
        a, b = np.unique(every[:m]), np.unique(every[m // 2 : m // 2 + n])
        p, q = (jaccardjoin.parities(x).tolist() for x in (a, b))
        df = spark.createDataFrame([(p, q)], "p array<bigint>, q array<bigint>")
        found, back = df.select(jaccardjoin.apart(F.col("p"), F.col("q")), jaccardjoin.apart(F.col("q"), F.col("p"))).first()
        assert found == back and 0 < found <= len(np.setxor1d(a, b)) and (found - len(np.setxor1d(a, b))) % 2 == 0
