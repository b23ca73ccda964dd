"""Discovery from text columns: links of pages, sitemaps, feeds."""

from __future__ import annotations

from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.url import matches_any, normal_feed, normal_strict


def links_of(html: str | None) -> list[str]:
    """The ``href`` of every anchor, in order, repeats kept."""
    found: list[str] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            if tag == "a":
                found.extend(v for k, v in attrs if k == "href" and v)

    Reader().feed(html or "")
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def links(html: pd.Series) -> pd.Series:
    return html.map(links_of)


def _text(xml: str | None):
    try:
        return ElementTree.fromstring((xml or "").strip())
    except ElementTree.ParseError:
        return None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def feed_entries(xml: str | None) -> list[tuple[str, str]]:
    """``(title, link)`` of an RSS or Atom text; an Atom entry's alternate link, else its first.  None for other text."""
    root = _text(xml)
    out: list[tuple[str, str]] = []
    for item in root.iter() if root is not None else ():
        if _local(item.tag) not in ("item", "entry"):
            continue
        title = next((c.text or "" for c in item if _local(c.tag) == "title"), "")
        refs = [c for c in item if _local(c.tag) == "link"]
        own = next((c.text.strip() for c in refs if c.text and c.text.strip()), None)
        alternate = next((c.get("href") for c in refs if c.get("rel", "alternate") == "alternate" and c.get("href")), None)
        link = own or alternate or next((c.get("href") for c in refs if c.get("href")), None)
        if link:
            out.append((title.strip(), link))
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("link", T.StringType())])))
def entries(xml: pd.Series) -> pd.Series:
    return xml.map(lambda x: [{"title": a, "link": b} for a, b in feed_entries(x)])


def _sitemap(xml: Column) -> Column:
    """A sitemap's or index's entries; what isn't XML comes back as ``_corrupt_record`` and doesn't end the query, as it does with XPath."""
    return F.from_xml(xml, "url array<struct<loc string>>, sitemap array<struct<loc string>>, _corrupt_record string", {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def sitemap_urls(maps: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, most: int | None = None) -> DataFrame:
    """``(source_url)`` of the sitemap texts in ``maps(xml)``: normal form, first one of each, then globs, then at most ``most``.

    Element names count without their namespace; a text that isn't XML has no addresses (``sitemaps_expanded`` reports it).
    """
    urls = maps.select(F.explode(_sitemap(F.col("xml"))["url"]["loc"]).alias("loc")).select(normal_strict(F.trim("loc")).alias("source_url")).distinct()
    if include:
        urls = urls.where(matches_any(F.col("source_url"), include))
    if exclude:
        urls = urls.where(~matches_any(F.col("source_url"), exclude))
    return urls.orderBy("source_url").limit(most) if most else urls


def nested_sitemaps(maps: DataFrame) -> DataFrame:
    """``(loc)`` of the sitemaps that a sitemap index names."""
    return maps.select(F.explode(_sitemap(F.col("xml"))["sitemap"]["loc"]).alias("loc"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """``(url)`` of the sitemaps that robots files ``(text)`` name, once each."""
    return robots.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), F.lit(1))).alias("url")).distinct()


def sitemaps_expanded(roots: DataFrame, texts: DataFrame) -> DataFrame:
    """``(sitemap, loc, error)``: the addresses in the sitemaps ``roots(url)`` and in those that they name, one level down.

    ``texts(url, xml)`` are the fetched sitemaps, of several for an address the least.  A sitemap without a text, with one that isn't XML or without
    any entry is one row with its error and stops no other.  A sitemap that several name is read once; indexes below an index aren't followed.
    """
    known = texts.groupBy("url").agg(F.min("xml").alias("xml"))
    read = lambda names: names.join(known, "url", "left").select(F.col("url").alias("sitemap"), "xml", _sitemap(F.col("xml")).alias("m"))
    first = read(roots.select("url").where("url is not null").distinct())
    named = first.select(F.explode("m.sitemap.loc").alias("url")).where("url is not null").distinct()
    below = read(named.join(roots.select("url"), "url", "left_anti"))
    error = F.when(F.col("xml").isNull(), "no text").when(F.col("m._corrupt_record").isNotNull(), "invalid XML").when(F.col("m.url").isNull() & F.col("m.sitemap").isNull(), "no entries")
    every = first.unionByName(below).withColumn("error", error)
    found = every.select("sitemap", F.explode("m.url.loc").alias("loc"), F.lit(None).cast("string").alias("error")).where("loc is not null")
    return found.unionByName(every.where("error is not null").select("sitemap", F.lit(None).cast("string").alias("loc"), "error"))


def feed_urls(feeds: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """``(source_url, title)`` of feeds ``(xml)``; patterns are regular expressions, exclusion first."""
    rows = feeds.select(F.explode(entries("xml")).alias("e")).select(normal_feed(F.col("e.link")).alias("source_url"), F.col("e.title").alias("title"))
    rows = rows.groupBy("source_url").agg(F.min("title").alias("title"))
    if exclude:
        rows = rows.where(~F.col("source_url").rlike(exclude))
    return rows.where(F.col("source_url").rlike(include)) if include else rows


def crawl_edges(pages: DataFrame, external: bool = False) -> DataFrame:
    """``(src, dst)`` between pages ``(url, html)``: resolved links without fragments; other hosts only if ``external``."""
    from ..functions.url import absolute, domain

    rows = pages.select(F.col("url").alias("src"), F.explode(links("html")).alias("href"))
    rows = rows.where(~F.col("href").rlike("^(#|javascript:|mailto:|tel:)"))
    rows = rows.select("src", absolute("src", "href").alias("dst")).where("dst is not null").withColumn("dst", F.regexp_replace("dst", "#.*$", ""))
    return (rows if external else rows.where(domain(F.col("src")) == domain(F.col("dst")))).distinct()
