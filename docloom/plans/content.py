"""Registered queries of discovery, streaming windows, content columns and parsing, with their SQL.

Texts such as sitemaps, feeds and Markdown are made from table columns, so that the SQL states the expected values from the columns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import blocks, markdown
from ..functions import url as U
from ..functions import values as V
from ..sinks import tables
from ..sources import cms, pages
from ..streaming import events
from . import views
from .catalog import _EVENTS, ORACLE_SQL, _p, query

# -- windows over events ---------------------------------------------------------------------------------------------------


@query("event_windows", f"WITH {_EVENTS} SELECT time_bucket(INTERVAL 1 HOUR, created_at) AS start, status, count(*) AS n FROM e GROUP BY ALL")
def _(spark, sf):
    return events.counts_by_window(views.step_events(spark, sf), "1 hour")


@query("event_windows_sliding", f"""WITH {_EVENTS} SELECT time_bucket(INTERVAL 15 MINUTE, created_at) - to_minutes(15 * k) AS start, status, count(*) AS n
FROM e, (VALUES (0), (1), (2), (3)) w(k) GROUP BY ALL""")
def _(spark, sf):
    return events.counts_by_window(views.step_events(spark, sf), "1 hour", slide="15 minutes")


@query("event_sessions", f"""WITH {_EVENTS}, b AS (SELECT *, CASE WHEN created_at <= lag(created_at) OVER (PARTITION BY run_id ORDER BY created_at) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM e),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY run_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT run_id, min(created_at) AS start, max(created_at) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM c GROUP BY run_id, part""")
def _(spark, sf):
    return events.sessions(views.step_events(spark, sf), "6 hours")


@query("event_followed", f"""WITH {_EVENTS} SELECT a.run_id, a.id, b.id AS then_id FROM e a JOIN e b ON a.run_id = b.run_id AND b.created_at > a.created_at AND b.created_at <= a.created_at + INTERVAL 2 HOUR
WHERE a.status = 'view' AND b.status = 'purchase'""")
def _(spark, sf):
    e = views.step_events(spark, sf)
    return events.followed(e.where("status = 'view'"), e.where("status = 'purchase'"), "2 hours")


# -- discovery from texts ----------------------------------------------------------------------------------------------------


def _listed(spark, sf, entry, head: str, tail: str):
    """One text for each fifty pages: their entries between ``head`` and ``tail``."""
    rows = views.table(spark, sf, "pages").select(F.floor(F.col("page_id") / 50).alias("k"), entry.alias("e"))
    return rows.groupBy("k").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list("e")), ""), F.lit(tail)).alias("xml"))


def _escaped():
    return F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))


_STRICT = ORACLE_SQL["url_normalize_strict"]


@query("sitemap_scan", f"SELECT DISTINCT value AS source_url FROM ({_STRICT}) WHERE regexp_matches(value, 'example[.](org|net)') AND NOT contains(value, '/de/')")
def _(spark, sf):
    entry = F.concat(F.lit("<url><loc> "), _escaped(), F.lit(" </loc><priority>1</priority></url>"))
    maps = _listed(spark, sf, entry, '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>")
    return pages.sitemap_urls(maps, include=["*example.org*", "*example.net*"], exclude=["*/de/*"])


@query("sitemap_index", "SELECT url AS loc FROM pages")
def _(spark, sf):
    maps = _listed(spark, sf, F.concat(F.lit("<sitemap><loc>"), _escaped(), F.lit("</loc></sitemap>")), "<sitemapindex>", "</sitemapindex>")
    return pages.nested_sitemaps(maps)


_NORMAL = ORACLE_SQL["url_normalize_engine"]
_FEED = f"SELECT n.value AS source_url, min('Page ' || n.page_id) AS title FROM ({_NORMAL}) n WHERE NOT regexp_matches(n.value, '/de/') AND regexp_matches(n.value, '^https') GROUP BY n.value"


@query("feed_scan_rss", _FEED)
def _(spark, sf):
    entry = F.concat(F.lit("<item><title>Page "), F.col("page_id"), F.lit("</title><link>"), _escaped(), F.lit("</link></item>"))
    return pages.feed_urls(_listed(spark, sf, entry, '<rss version="2.0"><channel>', "</channel></rss>"), include="^https", exclude="/de/")


@query("feed_scan_atom", _FEED)
def _(spark, sf):
    entry = F.concat(F.lit("<entry><title>Page "), F.col("page_id"), F.lit('</title><link rel="self" href="https://e.org/x"/><link href="'), _escaped(), F.lit('"/></entry>'))
    return pages.feed_urls(_listed(spark, sf, entry, '<feed xmlns="http://www.w3.org/2005/Atom">', "</feed>"), include="^https", exclude="/de/")


@query("crawl_edges", f"""SELECT DISTINCT url AS src, {_p(1)} || '://' || {_p(2)} || href AS dst FROM (SELECT url, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)""")
def _(spark, sf):
    return pages.crawl_edges(views.table(spark, sf, "pages"))


# -- columns of orders, customers and pages ------------------------------------------------------------------------------------


def _columns(name: str, table: str, key: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    query(name, f"SELECT {key}, {sql} FROM {table}")(lambda spark, sf: views.table(spark, sf, table).select(key, *[c.alias(n) for n, c in columns().items()]))


_key = lambda: F.col("o_orderkey").cast("string")
_user = lambda: F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
_post = lambda: F.concat(F.lit("https://X.com/"), _user(), F.lit("/status/"), _key())
_columns(
    "post_ids", "orders", "o_orderkey", "o_orderkey::VARCHAR AS tweet, NULL::VARCHAR AS other, 'u' || o_custkey AS profile, 'u' || o_custkey AS tab, NULL::VARCHAR AS own",
    lambda: dict(tweet=U.tweet_id(F.concat(_post(), F.lit("?s=20"))), other=U.tweet_id(F.concat(F.lit("https://example.org/a/status/"), _key())),
    profile=U.profile_name(F.concat(F.lit("https://twitter.com/"), _user(), F.lit("/"))), tab=U.profile_name(F.concat(F.lit("https://www.x.com/"), _user(), F.lit("/media"))), own=U.profile_name(F.lit("https://x.com/settings"))),
)
_columns(
    "item_urls", "orders", "o_orderkey", "'https://twitter.com/i/status/' || o_orderkey AS t, 'https://twitter.com/u' || o_custkey AS u, 'https://linkedin.com/posts/' || o_orderkey AS l, 'https://substack.com/p/' || o_orderkey AS s, NULL::VARCHAR AS n",
    lambda: dict(t=U.item_url(_key(), F.lit("Twitter")), u=U.item_url(_user(), F.lit("twitter")), l=U.item_url(_key(), F.lit("linkedin")), s=U.item_url(_key(), F.lit("substack")), n=U.item_url(_key(), F.lit("threads"))),
)
_columns(
    "safe_integers", "orders", "o_orderkey", "o_orderkey AS whole, o_custkey AS listed, 0::BIGINT AS word, 0::BIGINT AS missing",
    lambda: dict(whole=V.safe_int(_key()), listed=V.safe_int(F.concat(F.lit("["), F.col("o_custkey"), F.lit(", 7]"))), word=V.safe_int(F.col("o_orderpriority")), missing=V.safe_int(F.lit(None).cast("string"))),
)
_stored = lambda f: V.parsed_time(F.date_format("o_orderdate", f))
_columns(
    "stored_times", "orders", "o_orderkey", "o_orderdate AS plain, o_orderdate AS iso, o_orderdate AS micros, o_orderdate AS zone, NULL::TIMESTAMP AS word, o_orderdate AS date, TIMESTAMP '2024-01-01' AS fallback",
    lambda: dict(plain=_stored("yyyy-MM-dd HH:mm:ss"), iso=_stored("yyyy-MM-dd'T'HH:mm:ss"), micros=_stored("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone=_stored("yyyy-MM-dd'T'HH:mm:ssXXX"), word=V.parsed_time(F.col("o_orderpriority")),
    date=V.parsed_date(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("2024-01-01").cast("timestamp")), fallback=V.parsed_date(F.col("o_orderpriority"), F.lit("2024-01-01").cast("timestamp"))),
)
_json = lambda **c: F.to_json(F.struct(F.struct(*[F.col(v).alias(n) for n, v in c.items()]).alias("usage")))
_pair = lambda u, n: u[f"tokens_{n}"]
_full = lambda: V.usage(_json(prompt_tokens="o_custkey", completion_tokens="o_orderkey"))
_total = lambda: V.usage(_json(total_tokens="o_orderkey", output_tokens="o_custkey"))
_columns(
    "token_usage", "orders", "o_orderkey", "o_custkey AS a, o_orderkey AS b, o_orderkey - o_custkey AS c, o_custkey AS d, 0::BIGINT AS e",
    lambda: dict(a=_pair(_full(), "in"), b=_pair(_full(), "out"), c=_pair(_total(), "in"), d=_pair(_total(), "out"), e=_pair(V.usage(F.lit("{}")), "in")),
)

_document = lambda: F.to_json(F.struct(F.col("c_name").alias("title"), F.struct(F.col("c_mktsegment").alias("current")).alias("slug"), F.array(F.struct(F.col("c_mktsegment").alias("name")), F.struct(F.lit("all").alias("name"))).alias("tags")))
_columns(
    "cms_fields", "customer", "c_custkey", """c_name AS title, c_mktsegment AS slug, c_mktsegment AS ref, '["' || c_mktsegment || '","all"]' AS names, '[]' AS none,
    'https://e.org/' || CASE c_mktsegment WHEN 'BUILDING' THEN 'build/' ELSE '' END || c_custkey AS url""",
    lambda: dict(title=cms.field_value(_document(), "title"), slug=cms.field_value(_document(), "slug.current"), ref=cms.field_value(_document(), "slug->current"), names=cms.field_value(_document(), "tags[]->name"), none=cms.field_value(_document(), "gone[]"),
    url=cms.document_url(F.col("c_custkey").cast("string"), "https://e.org/", F.col("c_mktsegment"), {"BUILDING": "/build/"})),
)
_sentence = lambda: F.concat(F.lit("Move the "), F.when(F.col("c_custkey") % 3 == 0, "WordPress").when(F.col("c_custkey") % 3 == 1, "content system").otherwise("shop"), F.lit(" of "), F.col("c_name"))
_columns("cms_mentions", "customer", "c_custkey", "c_custkey % 3 < 2 AS mentioned, CASE c_custkey % 3 WHEN 0 THEN 'wordpress' END AS platform", lambda: dict(mentioned=V.cms_mention(_sentence())["mentioned"], platform=V.cms_mention(_sentence())["platform"]))
_columns("comma_lists", "customer", "c_custkey", "c_name || '|' || c_mktsegment AS parts", lambda: dict(parts=F.array_join(V.comma_list(F.concat(F.lit(" ,"), F.col("c_name"), F.lit(" ,, "), F.col("c_mktsegment"), F.lit(","))), "|")))


@query("nested_as_json", """SELECT c_custkey, '{"name":"' || c_name || '","nation":' || c_nationkey || '}' AS s, '["' || c_mktsegment || '",null]' AS a FROM customer""")
def _(spark, sf):
    rows = views.table(spark, sf, "customer")
    return tables.encoded(rows.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("s"), F.array("c_mktsegment", F.lit(None)).alias("a")))


_line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
_name = lambda: F.col("c_name")
_segment = lambda: F.col("c_mktsegment")
_headed = lambda: F.when(F.col("c_custkey") % 2 == 0, _line("intro\n# ", _name(), "\ntext")).otherwise("## no title")
_columns("markdown_titles", "customer", "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'My Old Page' END AS title", lambda: dict(title=V.markdown_title(_headed(), F.lit("my-old_page"))))
_columns(
    "markdown_images", "customer", "c_custkey", "'![a](' || c_mktsegment || ')' || repeat(chr(10), 3) || 'text' || chr(10) || '![c](' || c_mktsegment || ')' || chr(10) || '![d](other)' AS text",
    lambda: dict(text=V.images_deduplicated(_line("![a](", _segment(), ")\n\n![b](", _segment(), ")\n\ntext\n![c](", _segment(), ")\n![d](other)\n![e](", _segment(), ")"))),
)
_matter = lambda: markdown.front_matter(F.when(F.col("c_custkey") % 2 == 0, _line("---\nname: ", _name(), "\n---\n", _segment(), "\n---\n")).otherwise(_segment()))
_columns(
    "front_matter", "customer", "c_custkey", "CASE WHEN c_custkey % 2 = 0 THEN 'name: ' || c_name END AS matter, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || chr(10) || '---' || chr(10) ELSE c_mktsegment END AS body",
    lambda: dict(matter=_matter()["matter"], body=_matter()["body"]),
)
_text = lambda: _line("# ", _name(), "\n\nfirst line\n  of ", _segment(), "\n> quoted\n```sql\nSELECT 1\n\n```\n#### no heading")
_block = lambda style, text: '{"_type": "block", "style": "' + style + '", "children": [{"_type": "span", "text": "' + text + '", "marks": []}], "markDefs": []}'
_expected = "[" + ", ".join([_block("h1", "' || c_name || '"), _block("normal", "first line of ' || c_mktsegment || '"), _block("blockquote", "quoted"), '{"_type": "code", "language": "sql", "code": "SELECT 1\\n"}', _block("normal", "#### no heading")]) + "]"
_columns("markdown_to_blocks", "customer", "c_custkey", f"'{_expected}' AS blocks", lambda: dict(blocks=blocks.to_blocks(_text())))
_columns(
    "blocks_to_markdown", "customer", "c_custkey", "'# ' || c_name || repeat(chr(10), 2) || 'first line of ' || c_mktsegment || repeat(chr(10), 2) || '> quoted' || repeat(chr(10), 2) || '```sql' || chr(10) || 'SELECT 1' || repeat(chr(10), 2) || '```' || repeat(chr(10), 2) || '#### no heading' AS text",
    lambda: dict(text=markdown.from_blocks(blocks.to_blocks(_text()))),
)
_columns("absolute_links", "pages", "page_id", f"{_p(1)} || '://' || {_p(2)} || '/a?b=1' AS path, 'https://e.org/x' AS whole, NULL::VARCHAR AS mail", lambda: dict(path=U.absolute(F.col("url"), F.lit("/a?b=1")), whole=U.absolute(F.col("url"), F.lit("https://e.org/x")), mail=U.absolute(F.col("url"), F.lit("mailto:a@e.org"))))
