"""The content of whole pages, found by scoring blocks against their neighbours.

A page is cut at its block elements.  Running counts over the blocks in order tell what is open at each (furniture, an article,
lists), so nested elements and missing wrappers don't matter.  Within an ``<article>`` or ``<main>`` a block stays unless it is made of
links; on other pages the words and the share of link text of a block and of those before and after it decide, by the rules and
thresholds of Kohlschütter, Fankhauser and Nejdl, "Boilerplate Detection using Shallow Text Features" (2010).  All of it is expressions
and windows over ``(page, place)``: one shuffle of the pages' text.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements that start a block.
BLOCKS = "p|div|section|article|main|body|nav|header|footer|aside|form|ul|ol|li|table|thead|tbody|tfoot|tr|caption|blockquote|pre|figure|figcaption|dl|dt|dd|h[1-6]|hr|address|details|summary|fieldset"
#: Elements without text of the page.
HIDDEN = ("script", "style", "noscript", "template", "svg", "iframe", "head", "button", "select", "textarea")
#: Blocks that are no content; a header or footer within an article belongs to it.
FURNITURE, OUTSIDE = ("nav", "aside", "form"), ("header", "footer")
#: Fixed values of the paper's decision tree: shares of link text, numbers of words.
LINKS, LINKS_BEFORE = 0.333333, 0.555556
WORDS, WORDS_NEXT, WORDS_BEFORE, WORDS_LONG, WORDS_NEXT_LONG = 16, 15, 4, 40, 17
#: Within an article a block of more link text than this is furniture.
LINKS_INSIDE = 0.5
_INLINE = [
    (r"(?is)<img\s[^>]*?alt=[\"']([^\"']*)[\"'][^>]*?src=[\"']([^\"']+)[\"'][^>]*>", "![$1]($2)"),
    (r"(?is)<img\s[^>]*?src=[\"']([^\"']+)[\"'][^>]*?alt=[\"']([^\"']*)[\"'][^>]*>", "![$2]($1)"),
    (r"(?is)<img\s[^>]*?src=[\"']([^\"']+)[\"'][^>]*>", "![]($1)"),
    (r"(?is)<a\s[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a\s*>", "[$2]($1)"),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r"(?i)</t[dh]\s*>\s*<t[dh](?:\s[^>]*)?>", " | "),
]


def decoded(text: Column) -> Column:
    """Character references as characters: the named ones of HTML 4, decimal and hexadecimal ones; others stay as they are."""
    names = F.create_map(*[F.lit(x) for name, code in {**name2codepoint, "apos": 39}.items() for x in (name, code)])

    def one(piece: Column) -> Column:
        name, digits, hexed = (F.regexp_extract(piece, p, 1) for p in (r"^([A-Za-z][A-Za-z0-9]*);", r"^#([0-9]{1,7});", r"^#[xX]([0-9A-Fa-f]{1,6});"))
        code = F.coalesce(names[name], F.nullif(digits, F.lit("")).cast("int"), F.conv(F.nullif(hexed, F.lit("")), 16, 10).cast("int"))
        code = F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), code)
        mark = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.coalesce(F.concat(mark, F.regexp_replace(piece, "^[^;]*;", "")), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&", -1)
    return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), one), ""))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.regexp_replace(text, "(?s)<[^>]*>", " "), r"[\t\n\r ]+"), lambda w: w != ""))


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, place, tag, text, words, links, inside, lists, kept)``: each block with text, in the order of its page.

    ``links`` is the share of words that are link text, ``inside`` whether the page's article is open, ``lists`` how many lists are, ``kept``
    whether it is content.  A heading goes with the first other block after it.  If nothing on a page were kept, all outside
    of furniture is.  Null and empty pages have no blocks.  Ids must be unique.
    """
    html = F.regexp_replace(F.col(html_col), r"(?s)<!--.*?-->", "")
    for tag in HIDDEN:
        html = F.regexp_replace(html, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    cut = F.split(F.regexp_replace(F.regexp_replace(html, "\x01", " "), rf"(?i)<(/?(?:{BLOCKS}))(\s[^>]*|/)?>", "\x01$1>"), "\x01")
    rows = pages.select(F.col(id_col).alias("id"), F.posexplode(cut).alias("place", "piece"))
    tag = F.lower(F.regexp_extract("piece", "^(/?[a-zA-Z0-9]+)>", 1))
    rows = rows.where("place > 0").select("id", "place", tag.alias("tag"), F.regexp_replace("piece", "^[^>]*>", "").alias("text"))
    page = Window.partitionBy("id")
    order = page.orderBy("place")

    def opened(*tags: str) -> Column:
        return F.sum(F.when(F.col("tag").isin(*tags), 1).when(F.col("tag").isin(*[f"/{t}" for t in tags]), -1).otherwise(0)).over(order)

    rows = rows.withColumns({"article": opened("article", "main"), "furniture": opened(*FURNITURE), "margin": opened(*OUTSIDE), "lists": opened("ul", "ol").cast("int")})
    rows = rows.withColumns({"inside": F.col("article") > 0, "words": _words(F.col("text"))})
    rows = rows.where("words > 0 and furniture <= 0 and (inside or margin <= 0)")
    loose = _words(F.regexp_replace("text", r"(?is)<a(?:\s[^>]*)?>.*?</a\s*>", " "))
    rows = rows.withColumn("links", (F.col("words") - loose) / F.col("words"))
    near = {f"{name}_{at}": f("words" if name == "words" else "links").over(order) for name in ("words", "links") for at, f in (("before", F.lag), ("next", F.lead))}
    rows = rows.withColumns({**near, "framed": F.max("inside").over(page)})
    before, after = F.coalesce("words_before", F.lit(0)), F.coalesce("words_next", F.lit(0))
    short = ~((F.col("words") <= WORDS) & (after <= WORDS_NEXT) & (before <= WORDS_BEFORE))
    behind_links = (F.col("words") > WORDS_LONG) | (after > WORDS_NEXT_LONG)
    scored = (F.col("links") <= LINKS) & F.when(F.coalesce("links_before", F.lit(0.0)) <= LINKS_BEFORE, short).otherwise(behind_links)
    content = F.when(F.col("framed"), F.col("inside") & (F.col("links") <= LINKS_INSIDE)).otherwise(scored)
    heading = F.col("tag").rlike("^h[1-6]$")
    rows = rows.withColumns({"content": content, "heading": heading})
    follows = F.first(F.when(~F.col("heading"), F.col("content")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    allowed = F.col("inside") | ~F.col("framed")
    rows = rows.withColumn("kept", F.when(F.col("heading"), allowed & F.coalesce(follows, F.lit(False))).otherwise(F.col("content")))
    rows = rows.withColumn("kept", F.col("kept") | ~F.max("kept").over(page))
    return rows.select(F.col("id").alias(id_col), "place", "tag", "text", "words", "links", "inside", "lists", "kept")


def _rendered() -> Column:
    """A block's Markdown, from its tag and text."""
    text = F.col("text")
    code = F.concat(F.lit("```\n"), F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]*>", ""), r"^\s*\n|\s+$", ""), F.lit("\n```"))
    for pattern, to in _INLINE:
        text = F.regexp_replace(text, pattern, to)
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</?code(?:\s[^>]*)?>", "`"), r"(?i)<br\s*/?>", "\x02")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]*>", ""), r"[\t\n\r ]+", " ")
    text = F.trim(F.regexp_replace(text, " ?\x02 ?", "\n"))
    marks = F.regexp_extract("tag", "^h([1-6])$", 1)
    item = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("lists") - 1, F.lit(0))), F.lit("- "), text)
    shown = F.when(marks != "", F.concat(F.repeat(F.lit("#"), F.try_to_number(marks, F.lit("9")).cast("int")), F.lit(" "), text)).when(F.col("tag") == "li", item)
    return decoded(shown.when(F.col("tag") == "pre", code).when(F.col("tag") == "blockquote", F.concat(F.lit("> "), text)).otherwise(text))


def page_content(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, content)``: each page's kept blocks as Markdown, items and table rows on lines of their own; null if it has none."""
    found = blocks(pages, id_col, html_col).where("kept").select(id_col, "place", F.when(F.col("tag").isin("li", "tr"), F.col("tag")).otherwise("").alias("line"), _rendered().alias("shown"))
    parts = F.array_sort(F.collect_list(F.struct("place", "line", "shown")))
    joined = F.aggregate(parts, F.struct(F.lit("").alias("text"), F.lit("").alias("line")), lambda s, x: F.struct(F.concat(s["text"], F.when(s["text"] == "", "").when((x["line"] != "") & (s["line"] == x["line"]), "\n").otherwise("\n\n"), x["shown"]).alias("text"), x["line"].alias("line")), lambda s: s["text"])
    return pages.select(id_col).join(found.groupBy(id_col).agg(joined.alias("content")), id_col, "left")
