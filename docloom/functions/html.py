"""Pages to Markdown and metadata, in regular expressions that stay in the JVM.

The content is what stands in ``<article>``, else in ``<main>``, else in ``<body>``, without scripts, navigation and other furniture.
Elements become Markdown step by step; what is left of tags goes, entities are decoded last.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are no content.
FURNITURE = ("script", "style", "noscript", "template", "svg", "iframe", "nav", "header", "footer", "aside", "form", "button")
#: (pattern, replacement) in order, after furniture is gone and white space is single blanks.
MARKDOWN = [
    *[(rf"(?i)<h{n}(?:\s[^>]*)?>", "\n\n" + "#" * n + " ") for n in range(1, 7)],
    (r"(?i)<li(?:\s[^>]*)?>\s*", "\n- "),
    (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
    (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
    (r"(?i)</?code(?:\s[^>]*)?>", "`"),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</t[dh]\s*>\s*<t[dh](?:\s[^>]*)?>", " | "),
    (r"(?i)</?(?:p|div|section|article|main|ul|ol|table|tr|blockquote|pre|figure|dl|dt|dd|h[1-6])(?:\s[^>]*)?>", "\n\n"),
    (r"<[^>]*>", ""),
]
#: Entities of marks and blanks; ``&amp;`` comes last.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&copy;": "©", "&reg;": "®", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&"}
#: Names under which pages give a fact, first one first.
META = {"title": ["og:title", "twitter:title"], "description": ["description", "og:description"], "author": ["author", "article:author"], "date": ["article:published_time", "date", "dc.date"], "fingerprint": []}


def decoded(text: Column) -> Column:
    """Named entities of ``ENTITIES`` as characters."""
    for name, mark in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(mark))
    return text


def meta(html: Column, name: str) -> Column:
    """The content of the first ``<meta>`` of this name or property, its attributes in either order; null without one."""
    own = rf"(?:name|property)\s*=\s*[\"']{name.replace('.', '[.]')}[\"']"
    value = r"content\s*=\s*[\"']([^\"'>]*)[\"']"
    found = [F.regexp_extract(html, rf"(?i)<meta\s[^>]*{pattern}", 1) for pattern in (rf"{own}[^>]*{value}", rf"{value}[^>]*{own}")]
    return decoded(F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in found]))


def _body(html: Column) -> Column:
    inside = [F.nullif(F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*)</{tag}\s*>", 1), F.lit("")) for tag in ("article", "main", "body")]
    return F.coalesce(*inside, html)


def markdown(html: Column) -> Column:
    """The content of a page as Markdown; null for null and for a page without any."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in FURNITURE:
        text = F.regexp_replace(text, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    text = F.regexp_replace(_body(text), r"\s+", " ")
    text = F.regexp_replace(text, r"(?i)<img\s[^>]*?alt=[\"']([^\"']*)[\"'][^>]*?src=[\"']([^\"']+)[\"'][^>]*>", "![$1]($2)")
    text = F.regexp_replace(text, r"(?i)<img\s[^>]*?src=[\"']([^\"']+)[\"'][^>]*?alt=[\"']([^\"']*)[\"'][^>]*>", "![$2]($1)")
    text = F.regexp_replace(text, r"(?i)<img\s[^>]*?src=[\"']([^\"']+)[\"'][^>]*>", "![]($1)")
    text = F.regexp_replace(text, r"(?i)<a\s[^>]*?href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a\s*>", "[$2]($1)")
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    text = F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.nullif(decoded(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit(""))


def extracted(html: Column) -> Column:
    """``struct<content,title,description,author,date,fingerprint>``; the fingerprint is the content's MD5."""
    title = F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    heading = F.nullif(F.regexp_extract(html, r"(?is)<h1[^>]*>([^<]*)</h1>", 1), F.lit(""))
    facts = {k: F.coalesce(*[meta(html, n) for n in names], F.lit(None).cast("string")) for k, names in META.items()}
    content = markdown(html)
    facts["title"] = F.coalesce(facts["title"], decoded(title), decoded(heading))
    facts["fingerprint"] = F.md5(content)
    return F.struct(content.alias("content"), *[c.alias(k) for k, c in facts.items()])
