"""The pipeline's near-copies: fingerprints first, then the prefix filter, and no work again within a class."""

import random

import corpus_pipeline
from docloom.llm import similar, simhash

from .helpers import CLASHING, documents


def test_the_pipelines_near_copies_meet_by_fingerprints_first(spark, monkeypatch):
    """The pairs that the prefix filter starts from are those of fingerprints within four bits."""
    rnd = random.Random(21)
    base = [" ".join(f"word{rnd.randint(0, 3000)}" for _ in range(300)) for _ in range(12)]
    rows = list(enumerate(base + [f"{t} end" for t in base] + [t.upper() for t in base[:4]] + [None, "", " "]))
    seen = []

    def near(index, sets, similarity, given=None):
        seen.append([(r.a, r.b) for r in given.collect()] if given is not None else [])
        nodes.update({r.node: r.fp for r in sets.select("node", "fp").collect()})
        return similar.near(index, sets, similarity, given)

    nodes = {}
    monkeypatch.setattr(simhash, "near", near)
    left = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows, **CLASHING), "").collect())
    assert left == [*range(12), 28]
    (pairs,) = seen
    bits = {p: bin((nodes[p[0]] ^ nodes[p[1]]) & (1 << 64) - 1).count("1") for p in pairs}
    assert pairs and max(bits.values()) <= 4 and all(a > b for a, b in pairs)
    linked = {n for n in nodes if any(m != n and bin((nodes[n] ^ nodes[m]) & (1 << 64) - 1).count("1") <= 4 for m in nodes)}
    assert linked == {n for p in pairs for n in p}


def test_shingles_of_one_class_do_not_meet_again(spark, monkeypatch):
    """Copies that are one class after the first comparison are in no join of a shingle's members."""
    rnd = random.Random(22)
    base = [f"word{rnd.randint(0, 3000)}" for _ in range(200)]
    texts = [" ".join(base[:k] + ["edit"] + base[k:]) for k in range(0, 200, 5)]
    sizes, keep = {}, similar.stored

    def stored(df, name):
        found = keep(df, name)
        sizes[name] = found.count()
        return found

    monkeypatch.setattr(similar, "stored", stored)
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, list(enumerate(texts))), "").collect()]
    assert left == [0] and sizes["texts-open"] == 0


def token_join_rows(spark, since):
    """Rows that joins on a shingle have made in the executions after ``since``."""
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(store.executionsList().size()):
        e = store.executionsList().apply(k)
        if e.executionId() <= since:
            continue
        values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and "[token" in node.desc() and "Inner" in node.desc():
                for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                    if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows


def test_copies_with_too_many_edits_make_few_pairs(spark, monkeypatch):
    """Common shingles get no row each in a join.  Copies outside of the leader's class meet its members only where lengths and places allow the similarity; what is kept agrees with all pairs."""
    monkeypatch.setattr(similar, "COMMON", 8)
    rnd = random.Random(23)
    base = [f"word{k}" for k in range(300)]

    def copy(edits):
        places = rnd.sample(range(50), edits)
        return " ".join(f"edit{rnd.randint(0, 10**9)}" if k % 6 == 3 and k // 6 in places else w for k, w in enumerate(base))

    texts = [copy(1 + k % 2) for k in range(60)] + [copy(8) for _ in range(60)]
    sets = [set(simhash.shingles_of(t, 5).tolist()) for t in texts]
    kept = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((kept[i], kept[j]))
                kept = [low if k == high else k for k in kept]
    store = spark._jsparkSession.sharedState().statusStore()
    since = max([store.executionsList().apply(k).executionId() for k in range(store.executionsList().size())], default=-1)
    left = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, list(enumerate(texts))), "").collect())
    made = token_join_rows(spark, since)
    assert left == sorted(set(kept))
    assert 0 < made < 10_000, made
