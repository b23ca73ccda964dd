"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text's words are lowered and freed of outer marks; numbers, names and the units behind numbers become typed
placeholders.  Windows of ``WINDOW`` consecutive template words are hash-joined between documents and benchmark items,
so a question is found with other numbers and names in it as well.  Documents first keep what the index has at all; an item starts from
its rarest windows alone, one of which a document that holds enough of it must have, so a template that many items share doesn't
pair each of them with each document.  A match through placeholders counts only if, along
one alignment of item and document, equal values of the item always meet equal values in the document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, stored

WINDOW = 5
#: A window with fewer literal words says too little as a template.
LITERAL = 3
#: Index rows up to which the benchmark's windows are broadcast: some 40 MB.  Beyond it both sides are shuffled by hash.
BROADCAST_ROWS = 400_000
#: Words that count as units behind a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz ton tons gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent degree degrees cent cents dollar dollars euro euros mph kmh watt watts volt volts hz khz mhz ghz kb mb gb tb"
).split()

#: Numbers in words.  "One" is left out, as it mostly isn't a number.
NUMBERS = (
    "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Words that begin a sentence without being its subject's name.
STARTERS = (
    "A An The This That These Those He She It We They You His Her Its Our Their Your My There Here How What Which Who When Where Why If "
    "As At In On Of For From By With After Before During While Each Every All Some Most Many No One Two Three And But Or So Then"
).split()
#: Verbs without an ending that shows them.
VERBS = (
    "has had is was are were have can could will would did made sold bought ate ran gave paid got took went read spent won lost found drove "
    "wrote drew built kept left put cut saw grew flew swam rode sent taught and"
).split()

#: In each pattern the cheapest and rarest test stands first.
_SUBJECT = rf"(?<!\S)(?=\p{{Lu}}\p{{Ll}})(?!(?:{'|'.join(STARTERS)})(?!\p{{L}}))(?=\p{{Lu}}\p{{Ll}}++(?:['’]s\s|\s(?:\p{{Ll}}{{2,}}(?:s|ed)|{'|'.join(VERBS)})\s))"
_NAME = rf"(?=\p{{Lu}}\p{{Ll}})(?<=[\p{{Ll}}\p{{N}},;:]\x20)|{_SUBJECT}"
_OUTER = r"(?<!\S)[^\p{L}\p{N}\x01\s]+|[^\p{L}\p{N}\x01\s]+(?!\S)"
_SPELLED = "(?=[" + "".join(sorted({w[0] for w in NUMBERS})) + "])(?:" + "|".join(NUMBERS) + ")"
_LARGE = "hundred|thousand|million|billion|dozen"
#: Blanks within a number of several words, which becomes one word.
_WITHIN = rf"\s(?={_SPELLED}(?![\p{{L}}\p{{N}}]))(?:(?<=(?<![\p{{L}}\p{{N}}])(?:{'|'.join(NUMBERS)})\s)|(?<=\p{{N}}\s)(?={_LARGE}))"
_JOINED = rf"(?=\p{{N}})(?<![\p{{L}}\p{{N}}.,])(\p{{N}}[\p{{N}}.,]*+)((?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))"
_NUMBER = rf"(?<!\S)(?:[-+]?\p{{N}}[\p{{N}}.,:/]*+|{_SPELLED})(?:-{_SPELLED})*+(?!\S)"
_UNIT = rf"(?<=<n>\s)(?:{'|'.join(UNITS)})(?!\S)"


def templates(text) -> tuple:
    """Two aligned columns of words: templates with placeholders ``<n> <name> <u>``, and the literal words.

    A name is a capitalised word inside a sentence, or one with a possessive or before a verb of the third person or the past.  Numbers
    are digits or words (``twenty-five``, ``3 million`` are one word each; capitalised inside a sentence they are names); a unit stands behind a number, joined to it or not.  All
    rules look at a word's neighbours only, so an item and a copy of it in a long text get the same templates.  Null: null.
    """
    named = F.lower(F.regexp_replace(text, _NAME, "\x01"))
    joined = F.regexp_replace(F.regexp_replace(named, _WITHIN, "-"), _JOINED, "$1 $2")
    marked = F.regexp_replace(F.regexp_replace(joined, _OUTER, ""), r"\s+", " ")
    literal = F.split(F.trim(F.translate(marked, "\x01", "")), " ")
    template = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r"\x01\S+", "<name>"), _NUMBER, "<n>"), _UNIT, "<u>")
    return F.split(F.trim(template), " "), literal


def windows(texts: DataFrame, *keys: str, short: tuple[int, ...] = ()) -> DataFrame:
    """``(*keys, at, h, slots)``: a row for each window under the hash of its literal words, without slots.

    A window with placeholders and still enough literal words has a second row under the hash of its template, whose ``slots`` hold
    the words at the placeholders (null elsewhere).  So other capitals or a list of numbers don't hide a copy.  ``short`` names smaller
    sizes whose literal windows are rows as well.
    """
    template, literal = templates(F.col("text"))
    rows = texts.select(*keys, template.alias("t"), literal.alias("l"))
    slot = F.transform("t", lambda w: w.isin("<n>", "<name>", "<u>"))
    at = F.filter(F.transform(slot, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    words = lambda name: F.transform(name, lambda w: F.xxhash64(w)).alias(name)
    hashed = F.struct(words("t"), words("l"), at.alias("at"), F.zip_with("l", slot, lambda w, x: F.when(x, w)).alias("values"))
    # Bound to lambda variables, so that the arrays are made once for a row and not once for a window.
    cut = lambda x, i, k=WINDOW: F.slice(x, i, F.lit(k))
    entry = lambda i, h, v: F.struct(i.alias("at"), h.alias("h"), v.alias("slots"))
    none = F.lit(None).cast("array<string>")
    starts = lambda d, k: F.when(F.size(d["t"]) >= k, F.sequence(F.lit(1), F.size(d["t"]) - k + 1)).otherwise(F.array().cast("array<int>"))
    exact = lambda d, k: F.transform(starts(d, k), lambda i: entry(i, F.xxhash64(cut(d["l"], i, k)), none))
    # Only windows around a placeholder are looked at again.
    last = lambda d: F.size(d["t"]) - WINDOW + 1
    around = lambda d: F.array_distinct(F.flatten(F.transform(d["at"], lambda p: F.sequence(F.greatest(p - WINDOW + 1, F.lit(1)), F.least(p, last(d))))))
    few = lambda d, i: F.size(F.filter(cut(d["values"], i), lambda w: w.isNotNull())) <= WINDOW - LITERAL
    typed = lambda d: F.transform(F.filter(around(d), lambda i: few(d, i)), lambda i: entry(i, F.xxhash64(cut(d["t"], i)), cut(d["values"], i)))
    with_slots = lambda d: F.when((F.size(d["at"]) > 0) & (last(d) >= 1), F.concat(exact(d, WINDOW), typed(d))).otherwise(exact(d, WINDOW))
    all_ = F.flatten(F.transform(F.array(hashed), lambda d: F.concat(with_slots(d), *[exact(d, k) for k in short]) if short else with_slots(d)))
    return rows.select(*keys, F.explode(all_).alias("w")).select(*keys, "w.*")


def _short_items(items: DataFrame) -> DataFrame:
    """``(item_id, i_at, h, i_slots, k)``: items of three words up to a window, as one literal window of all ``k`` words."""
    rows = items.select("item_id", templates(F.col("text"))[1].alias("l")).withColumn("k", F.size("l")).where(F.col("k").between(LITERAL, WINDOW - 1))
    h = F.transform(F.array("l"), lambda l: F.xxhash64(F.transform(l, lambda w: F.xxhash64(w))))[0]  # noqa: E741
    return rows.select("item_id", F.lit(1).alias("i_at"), h.alias("h"), F.lit(None).cast("array<string>").alias("i_slots"), "k")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.5, run: int = 13) -> DataFrame:
    """``(doc_id, row, item_id, windows, item_windows, through_slots)`` of each document that holds a benchmark item.

    It holds the item if it has ``share`` of the item's different windows, or as many as a passage of ``run`` words has.
    ``through_slots`` counts the windows found only with other values in their placeholders.  ``row`` is a hash of the text
    that tells apart rows with equal ids.  An item of three words up to a window is one literal window; those of one or two words match
    nothing, as most texts hold them by chance.  Null texts hold nothing; rows with a null id are reported with it.  Extra columns are
    ignored; an empty table on either side gives no rows.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").dropDuplicates(["item_id", "text"])
    brief = stored(_short_items(items).distinct(), "benchmark-brief")
    short = tuple(r["k"] for r in brief.select("k").distinct().orderBy("k").collect())  # at most WINDOW - LITERAL sizes
    index = windows(items, "item_id").select("item_id", F.col("at").alias("i_at"), "h", F.col("slots").alias("i_slots")).union(brief.drop("k"))
    index = stored(index.distinct(), "benchmark-windows")
    total = index.groupBy("item_id").agg(F.countDistinct("i_at").alias("item_windows"))
    total = stored(total.withColumn("enough", F.least(F.ceil(F.col("item_windows") * share), F.lit(run - WINDOW + 1))), "benchmark-items")
    small = (lambda df: F.broadcast(df)) if index.count() <= BROADCAST_ROWS else (lambda df: df)

    key = ["doc_id", "row", "item_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    often = index.select("h", "item_id").distinct().groupBy("h").agg(F.count("*").alias("often"))
    hits = stored(windows(texts, "doc_id", "row", short=short).join(small(often.select("h")), "h", "left_semi"), "hits")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("often", "i_at"))
    rarest = index.join(often, "h").groupBy("item_id", "i_at").agg(F.max("often").alias("often")).withColumn("_n", place).join(total, "item_id").where("_n <= item_windows - enough + 1")
    starts = stored(index.join(rarest.select("item_id", "i_at"), ["item_id", "i_at"]).select("h", "item_id").distinct(), "benchmark-starts")
    begun = stored(hits.join(small(starts), "h").select(*key).distinct(), "begun")
    same = [hits[c].eqNullSafe(begun[c]) for c in ("doc_id", "row")]
    found = hits.join(begun, same).select(hits["doc_id"], hits["row"], "item_id", "at", "h", "slots").join(small(index), ["h", "item_id"])
    # A literal row meets template rows of texts without placeholders; slots are compared where both have some.
    found = stored(found.select(*key, "at", "i_at", "slots", "i_slots"), "matches")

    line = [*key, (F.col("at") - F.col("i_at")).alias("shift")]
    both = found.where("slots is not null and i_slots is not null")
    pairs = both.select(*line, F.explode(F.arrays_zip("slots", "i_slots")).alias("p")).select(*key, "shift", "p.*").where("slots is not null or i_slots is not null")
    clash = pairs.groupBy(*key, "shift", "i_slots").agg(F.min("slots").alias("x"), F.max("slots").alias("y"), F.max(F.col("slots").isNull()).alias("gap"))
    clash = checkpointed(clash.where("x <> y or gap or i_slots is null").select(*key, "shift").distinct())
    direct = found.where("slots is null or i_slots is null").select(*key, "i_at", F.lit(0).alias("by_slot"))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*key, "shift"]]
    sound = both.select(*line, "i_at").distinct().alias("b").join(clash.alias("c"), same, "left_anti").select(*key, "i_at", F.lit(1).alias("by_slot"))
    held = direct.union(sound).groupBy(*key, "i_at").agg(F.min("by_slot").alias("by_slot"))
    held = held.groupBy(*key).agg(F.count("*").alias("windows"), F.sum("by_slot").alias("through_slots")).join(total, "item_id")
    return held.where("windows >= enough").select(*key, "windows", "item_windows", "through_slots")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, same columns, without the rows that hold a benchmark item."""
    bad = stored(leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_row"]), "left_anti")
