"""Scalar columns for text, JSON values, statuses, prices and citations."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- text ------------------------------------------------------------------------------------------------------------


def comma_list(text: Column, separator: str = ",") -> Column:
    """The trimmed, non-empty parts of a list in a string."""
    return F.filter(F.transform(F.split(text, re.escape(separator)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def keyword_match(text: Column, keywords: list[str]) -> Column:
    """Whether any keyword occurs, in any case; no keywords match everything."""
    return F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k)) if keywords else F.lit(True)


def matched_keywords(keywords: list[str], *texts: Column) -> Column:
    found = lambda k: [F.contains(F.lower(F.coalesce(t, F.lit(""))), F.lower(k)) for t in texts]

    def any_of(k):
        first, *more = found(k)
        for m in more:
            first = first | m
        return first

    return F.filter(F.array(*[F.lit(k) for k in keywords]), any_of) if keywords else F.array().cast("array<string>")


def relevance(score: Column, comments: Column) -> Column:
    return 0.7 * F.least(score / 100.0, F.lit(1.0)) + 0.3 * F.least(comments / 50.0, F.lit(1.0))


def html_title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def markdown_title(text: Column, stem: Column) -> Column:
    """The first ``# `` heading, else the file's name in words."""
    head = F.regexp_extract(text, r"(?m)^# (.*)$", 1)
    return F.when(head != "", F.trim(head)).otherwise(F.initcap(F.translate(stem, "-_", "  ")))


def citation_domain(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


#: A line that is one image, its address in the first group; blanks around it don't count.
_IMAGE_LINE = r"(?U)^\s*!\[[^\]]*\]\(([^)]+)\)\s*$"


def images_deduplicated(text: Column) -> Column:
    """Markdown without image lines that repeat an address of their section; a section starts with each line of text.

    The text is split before its lines of text, so a section is one such line with the images and blank lines up to the next.
    """
    sections = F.split(text, r"(?mdU)^(?![^\S\n]*$)(?![^\S\n]*!\[[^\]\n]*\]\([^)\n]+\)[^\S\n]*$)")
    lines = F.transform(sections, lambda s: F.split(s, "\n"))
    address = lambda line: F.regexp_extract(line, _IMAGE_LINE, 1)
    numbered = F.transform(lines, lambda ls: F.struct(ls.alias("lines"), F.transform(ls, address).alias("addresses")))

    def once(section: Column) -> Column:
        found = section["addresses"]
        first = lambda line, i: (F.get(found, i) == "") | (F.array_position(found, F.get(found, i)) == i + 1)
        return F.array_join(F.filter(section["lines"], first), "\n")

    return F.array_join(F.transform(numbered, once), "")


# -- JSON and identifiers ---------------------------------------------------------------------------------------------


def first_field(document: Column, names: list[str]) -> Column:
    """The first of several dotted paths that has a value."""
    return F.coalesce(*[F.get_json_object(document, f"$.{n}") for n in names])


def safe_int(value: Column) -> Column:
    """An integer, the first of a list, else 0."""
    return F.coalesce(value.try_cast("bigint"), F.get_json_object(value, "$[0]").try_cast("bigint"), F.lit(0))


def parsed_date(text: Column, as_of: Column) -> Column:
    return F.coalesce(text.try_cast("timestamp"), as_of)


def source_identifier(*columns: Column) -> Column:
    """The first of the columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def item_id(url: Column, text: Column) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(url, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 100))), 1, 12)


def item_title(title: Column, text: Column, url: Column) -> Column:
    """Up to 200 characters of the title, else of the first line, else the address, else 'Untitled'."""
    line = F.trim(F.substring_index(text, "\n", 1))
    return F.coalesce(F.nullif(F.substring(title, 1, 200), F.lit("")), F.nullif(F.substring(line, 1, 200), F.lit("")), F.nullif(url, F.lit("")), F.lit("Untitled"))


def cms_address(url: Column) -> Column:
    """``struct<platform,instance,schema,slug>`` of ``platform/instance[/schema]/slug``; null for web addresses."""
    parts = F.split(url, "/", 4)
    four = F.struct(parts[0].alias("platform"), parts[1].alias("instance"), parts[2].alias("schema"), F.get(parts, F.lit(3)).alias("slug"))
    three = F.struct(parts[0].alias("platform"), parts[1].alias("instance"), F.lit(None).cast("string").alias("schema"), F.get(parts, F.lit(2)).alias("slug"))
    return F.when(url.rlike("^https?://"), None).when(F.size(parts) == 4, four).when(F.size(parts) == 3, three)


#: Words that name a content platform, first one first, and words that mean one in general.
CMS_NAMES = [("sanity", "sanity"), ("contentful", "contentful"), ("wordpress", "wordpress"), ("wp", "wordpress")]
CMS_WORDS = ["cms", "content management", "content system"]


def cms_mention(text: Column) -> Column:
    """``struct<mentioned,platform>`` of a sentence about content management."""
    name = F.coalesce(*[F.when(F.lower(text).contains(word), platform) for word, platform in CMS_NAMES])
    return F.struct((name.isNotNull() | keyword_match(text, CMS_WORDS)).alias("mentioned"), name.alias("platform"))


# -- statuses and prices -----------------------------------------------------------------------------------------------

#: Workflow and step statuses as shown.
WORKFLOW_SHOWN = {"pending": "PENDING", "running": "PENDING", "completed": "SUCCESS", "completed_with_errors": "WARNING", "failed": "ERROR", "canceling": "PENDING", "canceled": "CANCELLED"}
STEP_SHOWN = {"completed": "success", "failed": "error", "canceled": "error"}

#: Prices for a million tokens in and out; earlier prefixes win; the first family's default is its first entry, the second's its last.
PREFIX_PRICES = [("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 5.0, 15.0), ("gpt-4-turbo", 10.0, 30.0), ("gpt-4", 30.0, 60.0), ("gpt-3.5-turbo", 0.50, 1.50)]
PART_PRICES = [("claude-3-opus", 15.0, 75.0), ("claude-3-5-sonnet", 3.0, 15.0), ("claude-3-sonnet", 3.0, 15.0), ("claude-3-haiku", 0.25, 1.25)]


def _looked_up(value: Column, table: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value), other)


def workflow_shown(status: Column) -> Column:
    low = F.lower(F.coalesce(F.nullif(status, F.lit("")), F.lit("unknown")))
    return _looked_up(low, WORKFLOW_SHOWN, F.upper(low))


def step_shown(status: Column) -> Column:
    low = F.lower(F.coalesce(F.nullif(status, F.lit("")), F.lit("pending")))
    return _looked_up(low, STEP_SHOWN, low)


def status_from_error(error: Column) -> Column:
    return F.when(F.nullif(error, F.lit("")).isNotNull(), "ERROR").otherwise("SUCCESS")


def source_type(method: Column) -> Column:
    return F.when(method == "folder", "file").when(method == "cms", "cms").otherwise("url")


def duration_ms(started: Column, completed: Column, as_of: Column) -> Column:
    """Milliseconds from start to end, or to ``as_of`` while it runs."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(F.coalesce(completed, as_of)) - micros(started)) / 1000).cast("bigint")


def model_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Estimated cost of a call; an unknown model costs its family's default."""
    cost = lambda a, b: (tokens_in * a + tokens_out * b) / 1_000_000
    other = model.startswith("claude")
    parts = F.when(other & model.contains(PART_PRICES[0][0]), cost(*PART_PRICES[0][1:]))
    for name, a, b in PART_PRICES[1:]:
        parts = parts.when(other & model.contains(name), cost(a, b))
    parts = parts.when(other, cost(*PART_PRICES[-1][1:]))
    for name, a, b in PREFIX_PRICES:
        parts = parts.when(model.startswith(name), cost(a, b))
    return parts.otherwise(cost(*PREFIX_PRICES[0][1:]))


# -- embeddings ----------------------------------------------------------------------------------------------------------


@F.pandas_udf(T.BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of one length."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    dot = total(F.zip_with(a, b, lambda x, y: (x * y).cast("double")))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: (x * x).cast("double"))))
    return dot / (norm(a) * norm(b))


# -- usage ---------------------------------------------------------------------------------------------------------------


def usage(response: Column) -> Column:
    """``struct<tokens_in,tokens_out>`` of a JSON answer; a missing input count is the total less the output."""
    get = lambda *names: F.coalesce(*[F.get_json_object(response, f"$.usage.{n}").try_cast("bigint") for n in names])
    out = F.coalesce(get("completion_tokens", "output_tokens"), F.lit(0))
    return F.struct(F.coalesce(get("prompt_tokens", "input_tokens"), get("total_tokens") - out, F.lit(0)).alias("tokens_in"), out.alias("tokens_out"))


#: The formats in which times are stored.
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss"]


def parsed_time(text: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS])


def batch_of(position: Column, size: int) -> Column:
    return F.floor(position / size)
