"""Markdown columns from structured content, in native expressions over parsed JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a content editor's block may hold, and the marks in front of its styles.
BLOCKS = (
    "array<struct<_type:string,_key:string,style:string,children:array<struct<text:string,marks:array<string>>>,"
    "markDefs:array<struct<_key:string,_type:string,href:string>>,code:string,language:string,alt:string>>"
)
STYLES = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "blockquote": "> "}
MARKS = {"strong": "**", "em": "*", "code": "`"}


def _span(child: Column, definitions: Column) -> Column:
    """A text run: its marks inside out in their order, its link around them."""
    marks = F.coalesce(child["marks"], F.array().cast("array<string>"))
    sign = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    wrap = lambda s, m: F.when(F.element_at(sign, m).isNull(), s).otherwise(F.concat(F.element_at(sign, m), s, F.element_at(sign, m)))
    text = F.aggregate(marks, F.coalesce(child["text"], F.lit("")), wrap)
    links = F.filter(F.coalesce(definitions, F.array().cast("array<struct<_key:string,_type:string,href:string>>")), lambda d: (d["_type"] == "link") & d["href"].isNotNull())
    hrefs = F.filter(F.transform(marks, lambda m: F.get(F.filter(links, lambda d: d["_key"] == m), F.lit(0))["href"]), lambda h: h.isNotNull())
    href = F.get(hrefs, F.lit(0))
    return F.when(href.isNull(), text).otherwise(F.concat(F.lit("["), text, F.lit("]("), href, F.lit(")")))


def from_blocks(blocks_json: Column) -> Column:
    """Markdown of a JSON list of blocks: text with styles and marks, code fences, images."""
    style = F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv])
    none = F.lit("")

    def block(b):
        text = F.array_join(F.transform(F.coalesce(b["children"], F.array().cast("array<struct<text:string,marks:array<string>>>")), lambda c: _span(c, b["markDefs"])), "")
        line = F.concat(F.coalesce(F.element_at(style, b["style"]), none), text)
        code = F.concat(F.lit("```"), F.coalesce(b["language"], none), F.lit("\n"), F.coalesce(b["code"], none), F.lit("\n```"))
        image = F.concat(F.lit("!["), F.coalesce(b["alt"], none), F.lit("](sanity-image-"), F.coalesce(b["_key"], F.lit("unknown")), F.lit(")"))
        kind = F.coalesce(b["_type"], F.lit("block"))
        return F.when(kind == "block", line).when(kind == "code", code).when(kind == "image", image)

    lines = F.filter(F.transform(F.from_json(blocks_json, BLOCKS), block), lambda x: x.isNotNull())
    return F.coalesce(F.regexp_replace(F.array_join(lines, "\n\n"), r"(?U)^\s+|\s+$", ""), none)


def post(author: Column, handle: Column, verified: Column, date: Column, url: Column, text: Column, counts: dict[str, Column]) -> Column:
    """A short post with its author, date, address and the counts that aren't zero."""
    head = F.concat(F.lit("# Tweet by "), F.coalesce(author, F.lit("Unknown")), F.lit(" (@"), F.coalesce(handle, F.lit("unknown")), F.lit(")"), F.when(verified, " ✓").otherwise(""))
    facts = F.concat_ws("\n", F.concat(F.lit("**Date:** "), date), F.concat(F.lit("**URL:** "), url))
    shown = F.concat_ws(" · ", *[F.when(n > 0, F.concat(F.format_number(n, 0), F.lit(f" {name}"))) for name, n in counts.items()])
    return F.concat_ws("\n\n", head, F.nullif(facts, F.lit("")), F.nullif(text, F.lit("")), F.when(shown != "", F.concat(F.lit("**Engagement:** "), shown)))


def front_matter(text: Column) -> Column:
    """``struct<matter,body>``: what stands between leading ``---`` lines, and the rest."""
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)(.*)\z"
    found = text.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(text, pattern, 1)).alias("matter"), F.when(found, F.regexp_extract(text, pattern, 2)).otherwise(text).alias("body"))


def citations(urls: Column) -> Column:
    """``array<struct<title,url,domain>>`` of an answer's sources, numbered from 1."""
    host = lambda u: F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.transform(urls, lambda u, i: F.struct(F.concat(F.lit("Source "), (i + 1).cast("string")).alias("title"), u.alias("url"), host(u).alias("domain")))
