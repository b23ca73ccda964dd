"""Operators that decide: fingerprint likeness, licenses, boilerplate, decontamination, quality, near copies, the pipeline."""

import hashlib
import random
import re
import textwrap
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import decontaminate, licenses, linededup, quality, similar, simhash, spotsigs
from docloom.llm.common import components

from .helpers import CLASHING, documents

SF = "/root/testdata/sf0.01"


def prose(rnd, n):
    return " ".join(rnd.choice(["the", "of", "and", "is", "a"]) if rnd.random() < 0.4 else f"word{rnd.randint(0, 5000)}" for _ in range(n))


def plain_signatures(text):
    """By the definition, word by word: an anchor and the two next words that aren't anchors."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    made = set()
    for k, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            after = [x for x in words[k + 1 :] if x not in spotsigs.ANCHORS][:2]
            if after:
                made.add(" ".join([w, *after]))
    if words and not made:
        made = {" ".join(words)}
    return {xxhash.xxh32_intdigest(x) for x in made}


def test_edited_likeness(spark):
    rnd = random.Random(1)
    rows = [(i * 3, prose(rnd, rnd.randint(0, 200))) for i in range(60)] + [(500, None), (501, ""), (502, "Ünï çødé 🙂 text"), (-7, prose(rnd, 90)), (502, "the same word"), (None, "the null word here"), (3, prose(rnd, 50)), (600, "the of and"), (601, "word " * 9000)]
    docs = documents(spark, rows, **CLASHING)
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.edited_likeness(docs).collect())
    hashes = {r.text: r.h for r in docs.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]), reverse=True)
    hexed = lambda s: "".join(f"{x:08x}" for x in sorted(s))
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = Counter()
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + n[:cut]
        a, b, c = map(plain_signatures, (t, edited, n))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), round(jaccard(a, b), 9), round(jaccard(a, c), 9)] += 1
    assert got == want
    one = spotsigs.edited_likeness(documents(spark, [(1, "the lonely document here")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert spotsigs.edited_likeness(documents(spark, rows).where("doc_id > 999")).collect() == []


def test_pruned_likeness():
    a, b = np.arange(10, dtype=np.uint32), np.arange(2, 12, dtype=np.uint32)
    assert spotsigs.likeness(a, b) == pytest.approx(8 / 12) and spotsigs.likeness(a, b, 0.7) == 0.0 and spotsigs.likeness(a[:5], a, 0.6) == 0.0
    assert spotsigs.likeness(a[:0], a[:0]) == 1.0 and spotsigs.likeness(a[:0], a) == 0.0
    for n in range(1, 400):
        for m in range(n, int(n / 0.8) + 1):
            assert spotsigs.length_class(m, 0.8) - spotsigs.length_class(n, 0.8) in (0, 1)


def classes(pairs):
    out = defaultdict(set)
    for node, root in pairs:
        out[root].add(node)
    return sorted(sorted(map(str, v)) for v in out.values())


def near_rows(rnd, maker):
    rows, i = [], 0
    for family in range(8):
        words = maker(rnd, 200).split()
        for _ in range(rnd.randint(1, 6)):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 3, 8, 30])):
                copy[rnd.randrange(len(copy))] = f"edit{rnd.randint(0, 10**6)}"
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(100, None), (101, ""), (102, rows[0][1]), (103, "the one"), (3, rows[3][1])]


def test_spot_groups(spark):
    rnd = random.Random(3)
    rows = near_rows(rnd, prose)
    base = prose(rnd, 300).split()  # many near copies that share most signatures, of different lengths
    rows += [(200 + k, " ".join(base[: 300 - rnd.randrange(90)] + ["the", f"own{k}", f"more{k}"])) for k in range(60)] + [(None, rows[0][1])]
    got = spotsigs.spot_groups(documents(spark, rows, **CLASHING)).collect()
    assert len(got) == len(rows)
    sets = [spotsigs.signatures(t or "") for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if spotsigs.likeness(sets[a], sets[b]) >= 0.8:
                ra, rb = root[a], root[b]
                root = [rb if x == ra else x for x in root]
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None) for r in root}
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter((rows[k][0], least[root[k]]) for k in range(len(rows)))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_near_copies(spark):
    rnd = random.Random(4)
    rows = near_rows(rnd, lambda r, n: " ".join(f"word{r.randint(0, 3000)}" for _ in range(n)))
    docs = documents(spark, rows + [(None, rows[0][1])], **CLASHING)
    got = [(r.doc_id, r.class_id) for r in simhash.text_classes(docs).collect()]
    shingles = lambda t: {tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))}
    sets, of = [shingles(t) for _, t in rows], dict(got)
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert np.mean([of[rows[a][0]] == of[rows[b][0]] for a, b in pairs]) >= 0.9
    for i, c in got:
        if i != c:  # linked to some other text of the class
            own = [k for k, r in enumerate(rows) if r[0] == i]
            assert any(of[rows[b][0]] == c and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a in own for b in range(len(rows)) if b != a)
    kept = simhash.near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({c: 1 for c in of.values()} | {None: 1})


def brute_kept(rows):
    """The ``(id, text)`` that stay: of each class linked at a Jaccard coefficient of 0.8 one with the smallest id; rows and the pairs linked."""
    sets = [{tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = list(range(len(rows)))
    for a, b in pairs:
        root = [root[b] if x == root[a] else x for x in root]
    return Counter(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def crowd(rnd, size, words=120, most=9):
    """Edited copies of one text, few of them near enough to the smallest."""
    base = [f"word{rnd.randint(0, 3000)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rnd.randint(0, most)):
            copy[rnd.randrange(words)] = f"edit{rnd.randint(0, 10**6)}"
        yield " ".join(copy)


def test_near_copies_where_many_meet(spark):
    rnd = random.Random(11)
    rows = list(enumerate([t for size in (30, 120) for t in crowd(rnd, size, most=5)] + [t.upper() for t in crowd(rnd, 1)]))
    rnd.shuffle(rows)
    assert Counter(r.doc_id for r in simhash.near_duplicates_removed(documents(spark, rows, **CLASHING)).collect()) == brute_kept(rows)


@pytest.mark.parametrize("common", [1, 32])
def test_near_copies_beyond_the_first_on_a_shingle(spark, monkeypatch, common):
    monkeypatch.setattr(similar, "COMMON", common)
    rnd = random.Random(12)
    shared = " ".join(f"notice{i}" for i in range(90))
    texts = [t for _ in range(3) for t in crowd(rnd, 25)] + [f"{shared} {t}" for _ in range(12) for t in crowd(rnd, 3, 40, 3)] + [None, "", " ", "one", "ONE ", "two words"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    assert Counter(r.doc_id for r in simhash.near_duplicates_removed(documents(spark, rows, **CLASHING)).collect()) == brute_kept(rows)
    assert simhash.near_duplicates_removed(documents(spark, rows).where("doc_id > 999")).collect() == []


def test_near_copies_of_different_texts_with_one_id(spark):
    rnd = random.Random(13)
    a, b, c, d = (next(crowd(rnd, 1)) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, c), (7, c), (5, c), (9, d), (9, d + " more")]
    left = [(r.doc_id, r.text) for r in simhash.near_duplicates_removed(documents(spark, rows, **CLASHING)).collect()]
    assert sorted(x for x in left if x[0] != 9) == sorted([(1, a), (5, b), (5, c)]) and sum(i == 9 for i, _ in left) == 1


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,\npublish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF\nMERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'


def test_license_rules(spark):
    rows = [
        (1, MIT + WARRANTY), (2, WARRANTY + "\n" + MIT), (3, "no end\nReleased under the MIT License.\nmore"), (5, None), (6, ""), (7, "licensed UNDER the   Apache License, version 2.0"),
        (8, "Licensed under CC BY-NC 4.0. Text. This work is licensed under the GNU General Public License, version 3."), (9, "The MIT License is mentioned here only."), (None, "Licensed under CC BY 4.0."), (8, "x"), (3, "no end\nReleased under the MIT License.\nmore"),
    ]
    got = sorted((r.doc_id or -1, r.license) for r in licenses.license_scan(documents(spark, rows, **CLASHING)).collect())
    assert got == [(-1, "CC-BY-4.0"), (1, "MIT"), (3, "MIT"), (7, "Apache-2.0"), (8, "CC-BY-NC-4.0"), (8, "GPL-3.0")]
    assert licenses.license_scan(documents(spark, rows).where("doc_id > 99")).collect() == []


def test_every_license_notice_is_recognised(spark):
    filled = lambda text: text.replace("{}", "Some Company, Inc.")
    wrapped = lambda text: "# " + "\n# ".join(textwrap.wrap(text, 70))
    n = len(licenses.NOTICES)
    rows = [(k, "Copyright 2020 A.\n\n" + filled(text)) for k, (_, text) in enumerate(licenses.NOTICES)]
    rows += [(n + k, "before\n\n" + wrapped(filled(text)).replace("# ", "") + "\n\nafter") for k, (_, text) in enumerate(licenses.NOTICES)]
    got = defaultdict(list)
    for r in licenses.license_scan(documents(spark, rows)).collect():
        got[r.doc_id].append(r.license)
    assert got == {k: [licenses.NOTICES[k % n][0]] for k in range(2 * n)}


def test_a_text_of_very_many_license_sentences(spark):
    first = licenses.NOTICES[[n for n, _ in licenses.NOTICES].index("BSD-2-Clause")][1].split(". ")[0]
    rows = [(1, f"{first}. Released under CC0 1.0. " * 50_000), (2, "Released under the MIT License. " * 100_000)]
    got = sorted((r.doc_id, r.license) for r in licenses.license_scan(documents(spark, rows)).collect())
    assert (2, "MIT") in got and all(i in (1, 2) for i, _ in got)


def test_license_gaps(spark):
    by = {k: [t for i, t in licenses.NOTICES if i == k][0] for k in ("BSD-2-Clause", "BSD-3-Clause")}
    three = by["BSD-3-Clause"].replace("Neither the name of {}", "Neither the name of Example Org. nor the names of its members").replace("{}", "US")
    odd = by["BSD-3-Clause"].replace("may be used to endorse", "can be named to endorse").replace("{}", "US")
    rows = [(1, three), (2, by["BSD-2-Clause"].replace("{}", "THEM")), (3, by["BSD-2-Clause"].replace("{}", "US") + "\n\n" + by["BSD-3-Clause"].replace("{}", "US")), (4, odd), (5, by["BSD-3-Clause"].replace("{}", ""))]
    got = defaultdict(set)
    for r in licenses.license_scan(documents(spark, rows)).collect():
        got[r.doc_id].add(r.license)
    assert got[1] == {"BSD-3-Clause"} and not got[4] and not got[5]
    assert got[2] == {"BSD-2-Clause"} and got[3] == {"BSD-2-Clause", "BSD-3-Clause"}


def test_boilerplate_lines(spark):
    rnd = random.Random(6)
    lines = {f"line {k}": rnd.sample(range(40), spread) for k, spread in enumerate([1, 2, 8, 9, 10, 11, 12, 13, 20, 40])}
    rows = [(s, "\n".join([f"own {s}"] + [x for x, sites in lines.items() if s in sites] + ["", f"own {s} end"]), f"site{s}") for s in range(40)]
    rows += [(50, None, None), (51, "line 9\n  line 9 \nline 0", None), (51, "line 9\n  line 9 \nline 0", None), (52, "", "site1"), (53, "line 9\r\n\t\r\n\x0bline 6\t \r\nown\r", "y"), (54, "\t\n\r\n", "z"), (None, "line 9\nlast", "x")]
    docs = documents(spark, rows, **CLASHING)
    got = linededup.boilerplate_removed(docs).collect()
    assert len(got) == len(rows)
    spread, blanks = defaultdict(set), " \t\x0b\x0c\r"
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            spread[x.strip(blanks)].add(s)
    wide = {x for x, s in spread.items() if len(s) >= 10 and x}
    for r in got:
        parts = (r.text or "").split("\n")
        kept = None if r.text is None else "\n".join(x for x in parts if x.strip(blanks) not in wide)
        assert r.kept == kept and r.n_removed == sum(x.strip(blanks) in wide for x in parts)
    exact = {r.sites for r in linededup.widespread_lines(docs).collect()}
    assert 10 in exact and 11 in exact
    assert Counter(linededup.boilerplate_removed(docs).columns).most_common(1)[0][1] == 1
    assert linededup.boilerplate_removed(docs.where("doc_id > 99")).collect() == []


QUESTION = "Yesterday Tom had 12 apples and gives 5 apples to his sister Mary before he walks 3 km home, so how many apples does Tom have left?"


def test_leaks(spark):
    rnd = random.Random(8)
    other = prose(rnd, 300)
    rows = [
        (1, other + "\n" + QUESTION + " " + other), (2, "x " + QUESTION.upper() + " y"), (3, QUESTION.lower()), (4, other), (5, None), (6, "too short"),
        (7, "" + QUESTION.replace("Tom", "Ann").replace("12", "40").replace("5 apples", "9 apples").replace("Mary", "Lucy").replace("3 km", "7 miles")),
        (8, "Yesterday Ann had 40 apples and gives 9 apples to his sister Lucy before he walks 7 miles home, so how many apples does Bob have left?"),
        (None, QUESTION), (4, QUESTION), (9, "he walks 3 km home"), (10, QUESTION.replace(" ", "\t\n ")), (3, QUESTION.lower()),
    ]
    bench = spark.createDataFrame([(0, QUESTION), (1, "tiny"), (2, None), (None, QUESTION), (3, " ".join(f"u{i}" for i in range(40)))], "item_id bigint, text string").selectExpr("*", "1 as h", "2 as at")
    docs = documents(spark, rows, **CLASHING)
    found = decontaminate.leaks(docs, bench).collect()
    assert Counter(r.doc_id for r in found if r.item_id == 0) == Counter([1, 2, 3, 7, None, 4, 10]) and all(r.item_id == 0 for r in found)
    by = {r.doc_id: r for r in found}
    assert by[7].through_slots > 0 and by[1].through_slots == 0 and by[1].windows == by[1].item_windows
    left = decontaminate.decontaminated(docs, bench)
    assert left.columns == docs.columns and sorted((r.doc_id, r.text is None) for r in left.collect()) == [(4, False), (5, True), (6, False), (8, False), (9, False)]
    assert decontaminate.leaks(docs, bench.where("item_id > 9")).collect() == [] and decontaminate.leaks(docs.where("doc_id > 99"), bench).collect() == []


def test_a_passage_of_an_item_is_enough_and_broadcast_isn_t_needed(spark, monkeypatch):
    item = " ".join(f"u{i}" for i in range(60))
    docs = documents(spark, [(1, " ".join(f"u{i}" for i in range(20, 33))), (2, " ".join(f"u{i}" for i in range(20, 32)))])
    bench = spark.createDataFrame([(0, item)], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert [r.doc_id for r in decontaminate.leaks(docs, bench).collect()] == [1]


def test_leaks_of_windows_full_of_placeholders(spark):
    numbers, names = "Find the sum of 12, 15, 18, 21, 24, 27, 30, 33, 36 and 39.", "Which Old Town Hall Was Built By Sir John Wood For King George In 1755"
    plain = "which of these rivers flows through the largest number of towns on its way down to the sea"
    bench = spark.createDataFrame([(0, numbers), (1, names), (2, plain)], "item_id bigint, text string")
    rows = [(1, "x " + numbers + " y"), (2, names), (3, names.lower()), (4, plain.title()), (5, "so find the sum of 7 at once"), (6, "Now we find the sum of 80 coins")]
    found = decontaminate.leaks(documents(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert {r.item_id: r.item_windows for r in found} == {0: 11, 1: 11, 2: 14} and all(r.windows >= r.item_windows - 1 for r in found)


def plain_templates(text):
    """Word by word: (template, literal) of each word."""
    raw = [(m[0], text[: m.start()], text[m.end() :]) for m in re.finditer(r"[^ \t\n\x0b\f\r]+", text or "")]
    words = []
    for n, (w, before, after) in enumerate(raw):
        inside = len(w) > 1 and regex.match(r"\p{Lu}\p{Ll}", w) and regex.search(r"[\p{Ll}\p{N},;:] \Z", before)
        start = regex.match(r"\p{Lu}\p{Ll}+", w)
        subject = False
        if start and start[0] not in decontaminate.STARTERS and after[:1].isspace():
            verb = raw[n + 1][0] if n + 1 < len(raw) and after[1:2] == raw[n + 1][0][0] and raw[n + 1][2][:1].isspace() else ""
            subject = w in (start[0] + "'s", start[0] + "’s") or (w == start[0] and bool(verb in decontaminate.VERBS or regex.fullmatch(r"\p{Ll}{2,}(s|ed)", verb)))
        name, w = bool(inside or subject), w.lower()
        clean = lambda x: regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", x)
        tail = regex.match(r"^[^\p{L}\p{N}.,]*(\p{N}[\p{N}.,]*)(\p{L}+)(?![\p{L}\p{N}])", w)
        parts = [tail[1], w[tail.start(2) :]] if tail and tail[2] in decontaminate.UNITS else [w]
        for k, part in enumerate(parts):
            joins = words and not name and clean(part) == part.rstrip(".,;?!") and (
                (re.split(r"[^\w]", words[-1][2])[-1] in decontaminate.NUMBERS and re.split(r"[^\w]", part)[0] in decontaminate.NUMBERS)
                or (words[-1][2][-1:].isdigit() and re.split(r"[^\w]", part)[0] in ("hundred", "thousand", "million", "billion", "dozen"))
            )
            if joins:
                words[-1] = (words[-1][0], clean(words[-1][2] + "-" + part), words[-1][2] + "-" + part)
            elif clean(part):
                words.append((name and k == 0, clean(part), part))
    out = []
    for name, w, _ in words:
        numeric = all(x in decontaminate.NUMBERS or (k == 0 and regex.fullmatch(r"\p{N}[\p{N}.,:/]*", x)) for k, x in enumerate(w.split("-")))
        unit = w in decontaminate.UNITS and out and out[-1][0] == "<n>"
        out.append(("<name>" if name else "<n>" if numeric else "<u>" if unit else w, w))
    return out


def plain_leak(doc, item):
    """(windows, item windows, through slots) of an item in a document, over all pairs of places; None if it isn't held."""
    d, i = plain_templates(doc), plain_templates(item)
    n = len(i) - 4
    if n < 1:
        return None
    slots = lambda w: {k: x[1] for k, x in enumerate(w) if x[0] in ("<n>", "<name>", "<u>")}
    direct, by_shift = set(), defaultdict(list)
    for b in range(n):
        for a in range(len(d) - 4):
            x, y = d[a : a + 5], i[b : b + 5]
            if [w[1] for w in x] == [w[1] for w in y]:
                direct.add(b)
            if [w[0] for w in x] == [w[0] for w in y] and 1 <= len(slots(x)) <= 2:
                by_shift[a - b].append((b, slots(x), slots(y)))
    through = set()
    for found in by_shift.values():
        values = defaultdict(set)
        for _, x, y in found:
            for k in y:
                values[y[k]].add(x[k])
        if all(len(v) == 1 for v in values.values()):
            through |= {b for b, _, _ in found}
    held = direct | through
    return (len(held), n, len(through - direct)) if len(held) >= min(-(-n // 2), 9) else None


@pytest.mark.parametrize("rows", [400_000, 0])
def test_leaks_against_all_places(spark, monkeypatch, rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    rnd = random.Random(21)
    names, things = ["Tom", "Ann", "Lucy", "Bob"], ["apples", "pears", "coins"]
    ask = "How many {t} does {a} have if {a} buys {x} {t} and gives {y} {t} to {b} who walks {y} km"
    fill = lambda t: t.format(t=rnd.choice(things), a=rnd.choice(names), b=rnd.choice(names), x=rnd.randint(1, 9), y=rnd.randint(1, 9))
    items = [(k, " ".join([*(f"own{k}w{j}" for j in range(rnd.randint(0, 9))), fill(ask), *(f"end{k}w{j}" for j in range(rnd.randint(0, 6)))])) for k in range(12)]
    texts = []
    for _ in range(50):
        words = rnd.choice(items)[1].split(" ") if rnd.random() < 0.6 else fill(ask).split(" ")
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            words[rnd.randrange(len(words))] = rnd.choice(["other", "Bob", "7", "--", "Lucy,"])
        words = words[rnd.randrange(4) :][: rnd.choice([60, 60, 14, 9])]
        texts.append("x y " + (" ".join(words) if rnd.random() < 0.5 else " ".join(words).lower()) + " z")
    docs = list(enumerate(texts))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.windows, r.item_windows, r.through_slots) for r in decontaminate.leaks(documents(spark, docs), bench).collect()}
    want = {(k, i): found for k, text in docs for i, item in items if (found := plain_leak(text, item))}
    assert got == want and any(x[2] for x in want.values())


#: Questions as sets of exercises have them; the fields are filled anew for a re-parameterised copy.
ASKED = [
    "{a} sells {x} eggs per day. {a} eats {y} for breakfast. {a} bakes {z} for friends. How much does {a} make?",
    "{a} has {x} marbles and gives {y} of them to {b}. How many marbles are left for {a} at the end of the day?",
    "A farmer named {a} keeps {x} cows and {y} goats in the field behind the house. How many animals does {a} keep in all?",
    "{a} ran {x} km on Monday and {y} km on Tuesday before the rain began. What is the total distance that {a} covered?",
    "{a} bought {x} kg of flour for a cake, but the recipe only needs {y} kg. How much flour remains after the cake is baked?",
    "There are {x} children on the bus when it leaves the school. At the first stop {y} children get off. How many children stay on the bus?",
    "{a}'s garden is {x} meters long and {y} meters wide. If a fence is built around it, how many meters of fence are needed?",
    "A train leaves the station at {x} and travels for {y} hours without a stop. When does the train arrive at the next station?",
    "{a} and {b} share a pizza that is cut into {x} slices. {a} eats {y} slices and {b} eats the rest. How many slices does {b} eat?",
    "A shop sells pencils in boxes of {x} and pens in boxes of {y}. How many boxes must a teacher buy for a class of {z} pupils?",
    "{a} reads {x} pages of a book every evening. The book has {z} pages in total. After how many evenings is the book finished?",
    "In a library {x} shelves hold {y} books each, and {z} more books lie on a table near the door. How many books does the library own?",
    "{a} earns {x} dollars an hour and works {y} hours in a week. How many dollars does {a} earn in {z} weeks of work?",
    "{a} filled {x} bottles with water from the well. Each bottle holds {y} liters when it is full. How much water did {a} carry home?",
]


def test_reparameterised_items_are_found(spark):
    """Recall of copies with other names, numbers in digits or words, and units joined or not; texts about other things stay."""
    rnd = random.Random(77)
    names = ["Janet", "Maria", "Tom", "Ann", "Lucy", "Omar", "Wei", "Ines", "Paul", "Nadia"]
    spelled = ["two", "twelve", "twenty five", "thirty-one", "forty", "3 hundred"]

    def fill(q, numbers):
        (a, b), (x, y, z) = rnd.sample(names, 2), rnd.sample(numbers, 3)
        return q.format(a=a, b=b, x=x, y=y, z=z)

    items = [(k, fill(q, [str(n) for n in range(3, 60)])) for k, q in enumerate(ASKED)]
    docs, planted = [], set()
    for k, q in enumerate(ASKED):
        for v in range(6):
            text = fill(q, spelled if v % 2 else [str(n) for n in range(60, 999)])
            text = text.replace(" km", "km").replace(" kg", "kg") if v == 4 else text
            docs.append((len(docs), prose(rnd, 60) + " " + text + " " + prose(rnd, 60)))
            planted.add((docs[-1][0], k))
    clean = [(1000 + n, prose(rnd, 150)) for n in range(30)]
    clean += [(2000, "Janet sells flowers in town. Maria eats alone. How much does Tom know about the 12 songs that he sings?"), (2001, "How many people are left at the end of the day? How much does it cost in all?")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, docs + clean), bench).collect()}
    assert len(found & planted) / len(planted) >= 0.9 and found <= planted, len(found & planted) / len(planted)
    verbatim = documents(spark, [(k, "so " + t.lower() + " and so on") for k, t in items])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(verbatim, bench).collect()} == {(k, k) for k, _ in items}
    for doc in docs:
        for k, item in items:
            assert (plain_leak(doc[1], item) is not None) == ((doc[0], k) in found), (doc, item)


def test_short_items_and_numbers(spark):
    bench = spark.createDataFrame([(0, "What is 2+2?"), (1, "Name the largest planet."), (2, "Why?"), (3, "yes no")], "item_id bigint, text string")
    rows = [(1, "Quiz: what is 2+2? Four."), (2, "what is 2+3"), (3, "NAME THE LARGEST PLANET"), (4, "Why? yes no"), (5, "what is"), (6, "name the largest moon and planet"), (7, None), (8, "")]
    found = decontaminate.leaks(documents(spark, rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.windows, r.item_windows) for r in found) == [(1, 0, 1, 1), (3, 1, 1, 1)]
    text = "It's cold. The dog runs far. Janet's 5kg bag, (twenty five) or 3 million, 1.5kg and 1990s; Tom and Ann sold two, three apples."
    got = spark.range(1).select(*decontaminate.templates(F.lit(text))).toDF("a", "b").first()
    assert got.a == "it's cold the dog runs far <name> <n> <u> bag <n> or <n> <n> <u> and <n> <u> <name> and <name> sold <n> <n> apples".split()
    assert got.b == "it's cold the dog runs far janet's 5 kg bag twenty-five or 3-million 1.5 kg and 1990 s tom and ann sold two three apples".split()
    long = "1.1," * 60_000 + " " + "two-" * 60_000 + "two " + "Ab " * 60_000 + "5kg" * 40_000
    assert decontaminate.leaks(documents(spark, [(1, long), (2, long + " what is 2+2")]), bench).select("doc_id").collect() == [(2,)]


def test_no_python_in_decontamination(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.windows(docs, "doc_id").join(bench, docs["doc_id"] == bench["item_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rated = quality.grades(labels)
    model = quality.train(docs, rated.where("doc_id % 3 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = quality.scored(docs.join(rated.where("doc_id % 3 = 0"), "doc_id"), model).collect()
    good = np.mean([r.tail_probability >= 0.4 for r in rows if r.grade == 2 and r.text])
    bad = np.mean([r.tail_probability >= 0.4 for r in rows if r.grade < 2])
    assert good > 0.9 and good - bad > 0.4
    assert all(0 <= r.tail_probability <= 1 and r.tail_probability <= r.expected_grade <= 2 for r in rows)


def test_quality_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "good words here"), (4, "nasty words here"), (None, "good words"), (3, "good words here")], expected_grade=7, **CLASHING)
    labels = spark.createDataFrame([(3, 1, 0), (4, 1, 1), (4, 1, 0), (None, 1, 0), (1, None, None), (9, 0, 0)], "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.grade for r in quality.grades(labels).collect()} == {3: 2, 4: 0, 9: 1}
    out = quality.selected(docs, labels)
    assert not {1, 2} & {r.doc_id for r in out.collect()}
    assert quality.selected(docs, labels.where("doc_id > 99")).count() == 6
    assert quality.selected(docs.where("doc_id > 99"), labels).collect() == []


def test_quality_trains_on_one_row_of_an_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, grades: seen.append(len(rows)))
    docs = documents(spark, [(i % 5, f"words {i} here") for i in range(50)] + [(8, "single words")], **CLASHING)
    quality.train(docs, quality.grades(spark.createDataFrame([(i, i % 2, 0) for i in range(9)], "doc_id bigint, quality int, toxic int")))
    assert seen == [6]


def test_quality_keeps_what_a_plain_loop_keeps(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id % 4 = 0")
    model = quality.train(docs, quality.grades(labels))
    kept = Counter()
    for r in docs.select("doc_id", "text").collect():
        words = quality.features(r.text or "")
        if len(words) and 1 / (1 + np.exp(model.thresholds[1] - sum(float(model.weights[x]) for x in words))) >= 0.4:
            kept[r.doc_id] += 1
    assert kept and Counter(r.doc_id for r in quality.selected(docs, labels).collect()) == kept


def plain_fit(rows, grades, steps, least=5, prior=3.6):
    """All features of all rows at once, two grades: what ``fit`` sums up in blocks."""
    size = 1 << quality.BITS
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    used = np.nonzero(np.bincount(flat, minlength=size) >= max(least, len(rows) / 600))[0]
    low, high = (np.log((np.bincount(flat[grades[row] == g], minlength=size) + 1) / ((grades == g).sum() + 2)) for g in (0, 1))
    scale, compact = np.abs(low - high)[used], np.full(size, -1)
    compact[used] = np.arange(len(used))
    col = compact[flat]
    row, col = row[col >= 0], col[col >= 0]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    w, first, m, v = np.zeros(len(used)), 0.0, [0, 0], [0, 0]
    for step in range(1, steps + 1):
        p = sigmoid(np.bincount(row, (w * scale)[col], len(rows)) - first)
        g = (p - grades) / len(rows)
        grads = np.bincount(col, g[row], len(used)) * scale + prior / len(rows) * w, -g.sum()
        m, v = [0.9 * a + 0.1 * b for a, b in zip(m, grads)], [0.99 * a + 0.01 * b * b for a, b in zip(v, grads)]
        w, first = (x - 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-9) for x, a, b in zip((w, first), m, v))
    full = np.zeros(size)
    full[used] = w * scale
    return full, first


def test_fit_holds_little_more_than_its_rows_and_sums_up_all_of_them(monkeypatch):
    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(0, 20_000, 1500, np.int32)) for _ in range(4000)]
    grade = rnd.integers(0, 2, len(rows))
    tracemalloc.start()
    quality.fit(rows, grade, steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5 * sum(r.nbytes for r in rows)
    some = slice(0, 300)
    monkeypatch.setattr(quality, "_SLICE", 1000)
    monkeypatch.setattr(quality, "_ROWS", 64)
    model, (weights, first) = quality.fit(rows[some], grade[some], steps=20), plain_fit(rows[some], grade[some], steps=20)
    assert np.count_nonzero(weights) > 500 and np.allclose(model.weights, weights, atol=1e-6) and np.allclose(model.thresholds, first)


def test_training_reads_features_without_an_object_for_each(spark):
    rnd = random.Random(6)
    texts = [(i, prose(rnd, 3000)) for i in range(200)]
    rated = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id bigint, grade int")
    docs, most = documents(spark, texts), {}

    def fit(rows, grades):
        most["fit"] = tracemalloc.get_traced_memory()[1]
        return rows

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(quality, "fit", fit)
        tracemalloc.start()
        rows = quality.train(docs, rated)
        tracemalloc.stop()
    assert sorted(map(tuple, rows)) == sorted(tuple(quality.features(t)) for _, t in texts)
    assert most["fit"] < 4 * sum(r.nbytes for r in rows)


def test_fit_orders_three_grades():
    rnd = np.random.default_rng(0)
    grade = rnd.integers(0, 3, 600)
    rows = [np.unique(np.concatenate([[1000 + g], rnd.integers(0, 200, 20)])).astype(np.int32) for g in grade]
    model = quality.fit(rows, grade)
    tails = np.array([model.tails(r) for r in rows])
    assert (tails[:, 0] >= tails[:, 1]).all() and ((tails[:, 1] > 0.5) == (grade == 2)).mean() > 0.99 and ((tails[:, 0] < 0.5) == (grade == 0)).mean() > 0.99


def test_fit_is_at_the_optimum_of_the_likelihood():
    rnd = np.random.default_rng(5)
    grade = rnd.integers(0, 3, 60)
    rows = [np.unique(np.concatenate([[g] if rnd.random() < 0.7 else [], rnd.integers(3, 9, 3)])).astype(np.int32) for g in grade]
    model = quality.fit(rows, grade, steps=6000, least=1)
    scale = quality.contrasts(np.concatenate(rows), np.array([len(r) for r in rows]), grade)

    def loss(weights, thresholds):
        """By the definition: P(y = g) from two neighbouring tails, and the prior on weights before their scale."""
        total = sum(3.6 / 2 * (weights[f] / scale[f]) ** 2 for f in range(9) if scale[f])
        for r, g in zip(rows, grade):
            tails = [1.0, *(1 / (1 + np.exp(t - sum(weights[f] for f in r))) for t in thresholds), 0.0]
            total -= np.log(tails[g] - tails[g + 1])
        return total

    w, t = model.weights[:9].astype(float), model.thresholds.astype(float)
    least = loss(w, t)
    for k in range(9 + 2):
        for step in (-0.02, 0.02):
            moved = np.concatenate([w, t])
            moved[k] += step
            assert k < 9 and not scale[k] or loss(moved[:9], moved[9:]) > least - 1e-4


def test_scores_are_evaluated_once(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plan = quality.selected(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    more = docs.selectExpr("*", "1 as expected_grade", "2 as tail_probability")
    assert quality.kept(more, labels).columns == more.columns and quality.kept(more, labels).where("expected_grade <> 1").isEmpty()


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        if name != "tokens":
            assert docs.columns == before.columns
    assert docs.count() == before.count() and docs.columns[0] == "doc_id"
