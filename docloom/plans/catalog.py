"""All registered queries of the reference side, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions import values as V
from ..functions import html, markdown
from ..operators import analytics, graph, registry, runs
from ..operators.registry import Filters
from ..operators.sql import run_sql
from ..sinks import tables
from ..sources import cms, providers, signals
from ..sources.files import accepted
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The views of ``views.py`` in the comparison's SQL.
_CANON = r"CASE WHEN regexp_matches(lower(trim(url)), '^https?://') THEN regexp_replace(lower(trim(url)), '/+$', '') ELSE lower(trim(url)) END"
_PART = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
_M = rf"""m AS (
  SELECT substr(sha256({_CANON}), 1, 12) AS document_id, page_id, url AS source_url, html, CASE WHEN page_id % 11 = 0 THEN 'file' ELSE 'url' END AS source_type,
    (['sitemap', 'crawl', 'rss'])[page_id % 3 + 1] AS discovery_method, CASE WHEN page_id % 7 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status,
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, CASE WHEN page_id % 7 = 0 THEN 'Invalid URL format' END AS error,
    'u' || page_id % 5 AS user_id, 'w' || page_id % 4 AS workspace_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(page_id::INTEGER) AS created_at
  FROM pages)"""
_X = rf"""x AS (
  SELECT substr(sha256({_CANON}), 1, 12) AS document_id, CASE doc_id % 5 WHEN 3 THEN 'ERROR' WHEN 4 THEN 'PENDING' ELSE 'SUCCESS' END AS status,
    CASE WHEN doc_id % 5 < 3 THEN n_chars ELSE 0 END::INTEGER AS content_length, sha256(text) AS content_hash, source AS fetch_engine,
    CASE WHEN doc_id % 5 = 3 THEN CASE WHEN doc_id % 2 = 0 THEN '403 Forbidden' ELSE '' END END AS error
  FROM documents JOIN pages ON doc_id = page_id WHERE lang <> 'de')"""
_VIEW = """SELECT m.document_id, m.source_url, m.source_type, m.discovery_method, m.title, m.status AS map_status, x.status AS fetch_status, x.content_length, x.fetch_engine,
  coalesce(nullif(x.error, ''), m.error) AS error,
  CASE WHEN x.status = 'SUCCESS' THEN 'fetched' WHEN x.status = 'PENDING' THEN 'fetching' WHEN m.status IS NOT NULL THEN 'mapped' ELSE 'unknown' END AS current_stage,
  (m.status = 'ERROR' OR coalesce(x.status = 'ERROR', FALSE)) AS has_error, (m.status = 'SUCCESS' AND (x.status IS NULL OR x.status IN ('PENDING', 'ERROR'))) AS is_fetchable,
  coalesce(x.status = 'SUCCESS', FALSE) AS is_fetched
FROM m LEFT JOIN x ON m.document_id = x.document_id"""
_JOINED = f"WITH {_M}, {_X} {_VIEW}"
_EVENTS = "e AS (SELECT event_id AS id, user_id AS run_id, 'step' || event_id % 4 AS step_id, event_type AS status, ts AS created_at, value AS current, props AS metadata_json FROM events)"
_TRACES = "t AS (SELECT conv_id AS workflow_id, turn, coalesce(role, 'none') AS model, length(coalesce(text, ''))::BIGINT AS input_tokens, turn * 10 AS output_tokens, CASE WHEN turn % 3 > 0 THEN turn * 100 END AS latency_ms FROM conversations)"
_SIGNALS = "s AS (SELECT doc_id, coalesce(lang, '') || ' by ' || coalesce(source, '') AS title, text AS snippet, n_chars % 500 AS score, doc_id % 70 AS comments, source AS subreddit FROM documents)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _listing(name: str, where: str, **filters) -> None:
    """A registry listing with some filters; ``where`` is the same in SQL."""
    query(name, f"{_JOINED} {where}")(lambda spark, sf: registry.listing(views.map_documents(spark, sf), views.fetch_documents(spark, sf), Filters(**filters)))


_listing("registry_left_join", "")
_listing("registry_url_contains_like", "WHERE m.source_url LIKE '%example.com/_r%'", url_contains="example.com/_r")
_listing("registry_url_contains_star", "WHERE m.source_url LIKE 'https://%/de/%'", url_contains="https://*/de/*")
_listing("registry_map_status", "WHERE m.status = 'ERROR'", map_status="ERROR")
_listing("registry_fetch_status", "WHERE x.status = 'SUCCESS'", fetch_status="SUCCESS")
_listing("registry_source_and_method", "WHERE m.source_type = 'url' AND m.discovery_method = 'rss' AND x.fetch_engine = 'src0'", source_type="url", discovery_method="rss", fetch_engine="src0")
_listing("registry_has_content", "WHERE x.content_length > 0", has_content=True)
_listing("registry_no_content", "WHERE x.content_length = 0 OR x.content_length IS NULL", has_content=False)
_listing("registry_min_content_length", "WHERE x.content_length >= 2000", min_content_length=2000)
_listing("registry_not_fetched", "WHERE x.document_id IS NULL OR x.status = 'PENDING'", not_fetched=True)
_listing("registry_has_error", "WHERE m.error IS NOT NULL OR x.error IS NOT NULL", has_error=True)
_listing("registry_no_error", "WHERE m.error IS NULL AND x.error IS NULL", has_error=False)
_listing("registry_tenant", "WHERE m.user_id = 'u1' AND m.workspace_id = 'w2'", user_id="u1", workspace_id="w2")
_listing("registry_time_range", "WHERE m.created_at >= TIMESTAMP '2024-01-02 00:00:00' AND m.created_at <= TIMESTAMP '2024-01-05 00:00:00'", created_after=datetime(2024, 1, 2), created_before=datetime(2024, 1, 5))
_listing("registry_glob_include_exclude", r"WHERE regexp_matches(m.source_url, '(?s)^https://.*/en/.*\z') AND NOT regexp_matches(m.source_url, '(?s)^.*\.html\z')", include=["https://*/en/*"], exclude=["*.html"])
_listing("registry_glob_limit", r"WHERE regexp_matches(m.source_url, '(?s)^.*/[df][re]/.*\z') ORDER BY m.source_url, m.document_id LIMIT 15", include=["*/[df][re]/*"], order_by="source_url", limit=15)
_listing("registry_glob_after_offset", r"WHERE m.document_id IN (SELECT document_id FROM m ORDER BY source_url, document_id OFFSET 40) AND regexp_matches(m.source_url, '(?s)^https://.*\z') ORDER BY m.source_url, m.document_id LIMIT 12", include=["https://*"], order_by="source_url", offset=40, limit=12)
_listing("registry_sort_offset_limit", "ORDER BY x.content_length DESC NULLS LAST, m.document_id LIMIT 20 OFFSET 5", order_by="content_length", descending=True, offset=5, limit=20)
_listing("registry_file_ext", "WHERE m.source_url LIKE '%.html'", file_ext="html")


@query("registry_dedup_keep_first", f"WITH {_M} SELECT document_id, page_id, source_type, discovery_method FROM (SELECT *, row_number() OVER (PARTITION BY discovery_method, source_type ORDER BY page_id) AS n FROM m) WHERE n = 1")
def _(spark, sf):
    rows = views.map_documents(spark, sf).withColumn("kind", F.concat_ws("|", "discovery_method", "source_type"))
    return registry.first_of_each(rows, "kind", "page_id").select("document_id", "page_id", "source_type", "discovery_method")


@query("registry_is_new", f"WITH {_M}, {_X} SELECT document_id, document_id NOT IN (SELECT document_id FROM x) AS is_new FROM m")
def _(spark, sf):
    return registry.with_newness(views.map_documents(spark, sf), views.fetch_documents(spark, sf)).select("document_id", "is_new")


@query("registry_delete", f"WITH {_M} SELECT document_id FROM m WHERE document_id NOT IN (SELECT document_id FROM m WHERE status = 'ERROR')")
def _(spark, sf):
    rows = views.map_documents(spark, sf)
    return registry.without(rows, rows.where("status = 'ERROR'")).select("document_id")


@query("registry_count", f"WITH {_M}, {_X} SELECT count(*) AS n FROM m LEFT JOIN x USING (document_id) WHERE x.status = 'SUCCESS'")
def _(spark, sf):
    return registry.listing(views.map_documents(spark, sf), views.fetch_documents(spark, sf), Filters(fetch_status="SUCCESS")).agg(F.count("*").alias("n"))


# -- aggregations ------------------------------------------------------------------------------------------------------


@query("status_counts", f"""WITH {_M}, {_X}, u AS (SELECT lower(status) AS status, count(*) AS n FROM x GROUP BY 1 UNION ALL SELECT 'pending', count(*) FROM m WHERE document_id NOT IN (SELECT document_id FROM x) HAVING count(*) > 0)
SELECT status, sum(n)::BIGINT AS n FROM u GROUP BY status""")
def _(spark, sf):
    return analytics.status_counts(views.map_documents(spark, sf), views.fetch_documents(spark, sf))


@query("status_summary", f"""WITH {_M}, {_X} SELECT count(*) AS total, count(*) FILTER (x.status = 'SUCCESS') AS fetched, count(*) FILTER (x.status IS NULL OR x.status = 'PENDING') AS not_fetched,
count(*) FILTER (x.status = 'ERROR') AS error, count(*) FILTER (x.status = 'SKIPPED') AS skipped FROM m LEFT JOIN x USING (document_id)""")
def _(spark, sf):
    return analytics.status_summary(views.map_documents(spark, sf), views.fetch_documents(spark, sf))


@query("domain_counts_topn", f"WITH d AS (SELECT regexp_extract(url, '{_PART}', 2) AS domain FROM pages) SELECT domain, count(*) AS n FROM d WHERE domain <> '' GROUP BY domain ORDER BY n DESC, domain LIMIT 10")
def _(spark, sf):
    return analytics.domain_counts(views.map_documents(spark, sf), 10)


_COST = "(input_tokens * 0.15 + output_tokens * 0.60) / 1000000"


@query("trace_summary", f"WITH {_TRACES} SELECT count(*) AS total_calls, coalesce(sum(input_tokens), 0)::BIGINT AS tokens_in, coalesce(sum(output_tokens), 0)::BIGINT AS tokens_out, round(coalesce(sum({_COST}), 0)::DOUBLE, 6) AS total_cost, avg(latency_ms) AS avg_latency_ms FROM t")
def _(spark, sf):
    return analytics.trace_summary(views.traces(spark, sf), V.model_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))


@query("trace_models", f"WITH {_TRACES} SELECT model, count(*) AS n FROM t GROUP BY model")
def _(spark, sf):
    return views.traces(spark, sf).groupBy("model").agg(F.count("*").alias("n"))


@query("trace_filter", f"WITH {_TRACES} SELECT * FROM t WHERE workflow_id = 3 AND model = 'user' ORDER BY turn DESC LIMIT 5")
def _(spark, sf):
    return views.traces(spark, sf).where("workflow_id = 3 and model = 'user'").orderBy(F.desc("turn")).limit(5)


@query("llm_cost_estimate", """WITH n(model) AS (VALUES ('gpt-4o-mini'), ('gpt-4o-2024'), ('gpt-4-turbo'), ('gpt-4'), ('gpt-3.5-turbo'), ('other'), ('claude-3-opus'), ('claude-x')),
p AS (SELECT p_partkey, model, p_partkey AS i, p_size AS o FROM part CROSS JOIN n)
SELECT p_partkey, model, (i * CASE model WHEN 'gpt-4o-2024' THEN 5.0 WHEN 'gpt-4-turbo' THEN 10.0 WHEN 'gpt-4' THEN 30.0 WHEN 'gpt-3.5-turbo' THEN 0.5 WHEN 'claude-3-opus' THEN 15.0 WHEN 'claude-x' THEN 0.25 ELSE 0.15 END::DOUBLE
  + o * CASE model WHEN 'gpt-4o-2024' THEN 15.0 WHEN 'gpt-4-turbo' THEN 30.0 WHEN 'gpt-4' THEN 60.0 WHEN 'gpt-3.5-turbo' THEN 1.5 WHEN 'claude-3-opus' THEN 75.0 WHEN 'claude-x' THEN 1.25 ELSE 0.6 END::DOUBLE) / 1000000 AS cost FROM p""")
def _(spark, sf):
    names = ("gpt-4o-mini", "gpt-4o-2024", "gpt-4-turbo", "gpt-4", "gpt-3.5-turbo", "other", "claude-3-opus", "claude-x")
    p = views.table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.array(*map(F.lit, names))).alias("model"))
    return p.select("p_partkey", "model", V.model_cost(F.col("model"), F.col("p_partkey"), F.col("p_size")).alias("cost"))


_VIEWS60 = f"""v AS (SELECT replace(regexp_extract(url, '{_PART}', 2), 'www.', '') || regexp_replace(regexp_extract(url, '{_PART}', 3), '/+$', '') AS url, ts FROM events JOIN pages ON event_id % (SELECT count(*) FROM pages) = page_id WHERE event_type = 'view'),
w AS (SELECT url, count(*) AS pageviews_60d, count(*) FILTER (ts >= TIMESTAMP '2024-01-16 00:00:00') AS pageviews_30d, count(*) FILTER (ts < TIMESTAMP '2024-01-16 00:00:00') AS pageviews_previous_30d
  FROM v WHERE ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts < TIMESTAMP '2024-01-31 00:00:00' GROUP BY url),
r AS (SELECT *, (pageviews_30d - pageviews_previous_30d) / nullif(pageviews_previous_30d, 0)::DOUBLE * 100 AS c FROM w),
a AS (SELECT url, pageviews_60d, pageviews_30d, pageviews_previous_30d, CASE WHEN pageviews_previous_30d = 0 THEN CASE WHEN pageviews_30d > 0 THEN 'increasing' ELSE 'stable' END WHEN c > 10 THEN 'increasing' WHEN c < -10 THEN 'decreasing' ELSE 'stable' END AS pageviews_trend, round(c, 1) AS trend_percentage FROM r)"""


def _windows(spark, sf):
    return analytics.pageview_windows(views.pageviews(spark, sf), F.lit("2024-01-31").cast("timestamp"), 30)


@query("pageview_windows_trend", f"WITH {_VIEWS60} SELECT * FROM a")
def _(spark, sf):
    return _windows(spark, sf)


@query("analytics_filter_sort", f"WITH {_VIEWS60} SELECT * FROM a WHERE url ILIKE '%EXAMPLE.com%' AND pageviews_30d >= 2 AND pageviews_trend = 'increasing' ORDER BY trend_percentage DESC NULLS LAST, url LIMIT 12")
def _(spark, sf):
    return analytics.page_listing(_windows(spark, sf), "EXAMPLE.com", 2, None, "increasing", "trend_percentage", 12)


@query("analytics_filter_count", f"WITH {_VIEWS60} SELECT count(*) AS total FROM a WHERE url ILIKE '%EXAMPLE.com%' AND pageviews_30d BETWEEN 1 AND 50 AND pageviews_trend = 'decreasing'")
def _(spark, sf):
    return analytics.page_count(_windows(spark, sf), "EXAMPLE.com", 1, 50, "decreasing")


@query("analytics_sync_totals", f"WITH {_VIEWS60} SELECT count(*) AS total_urls, coalesce(sum(pageviews_60d), 0)::BIGINT AS total_pageviews FROM a")
def _(spark, sf):
    return _windows(spark, sf).agg(F.count("*").alias("total_urls"), F.coalesce(F.sum("pageviews_60d"), F.lit(0)).alias("total_pageviews"))


# -- signals -----------------------------------------------------------------------------------------------------------

_REL = "0.7::DOUBLE * least(score / 100.0::DOUBLE, 1.0::DOUBLE) + 0.3::DOUBLE * least(comments / 50.0::DOUBLE, 1.0::DOUBLE)"


@query("signal_relevance_topk", f"WITH {_SIGNALS} SELECT doc_id, score, comments, {_REL} AS relevance FROM s ORDER BY relevance DESC, doc_id LIMIT 25")
def _(spark, sf):
    s = views.signals(spark, sf)
    return s.select("doc_id", "score", "comments", V.relevance(F.col("score"), F.col("comments")).alias("relevance")).orderBy(F.desc("relevance"), "doc_id").limit(25)


@query("signal_keywords", f"""WITH {_SIGNALS}, k AS (SELECT *, list_filter(['The', 'SCHACH', 'zorro'], lambda w: contains(lower(coalesce(title, '')), lower(w)) OR contains(lower(coalesce(snippet, '')), lower(w))) AS found FROM s)
SELECT doc_id, subreddit, array_to_string(found, ',') AS keywords FROM k WHERE score >= 100 AND len(found) > 0""")
def _(spark, sf):
    words = ["The", "SCHACH", "zorro"]
    s = views.signals(spark, sf).where("score >= 100").withColumn("found", V.matched_keywords(words, F.col("title"), F.col("snippet")))
    return s.where("size(found) > 0").select("doc_id", "subreddit", F.array_join("found", ",").alias("keywords"))


# -- scalar functions ----------------------------------------------------------------------------------------------------


def _scalar(name: str, column: Callable, sql: str) -> None:
    query(name, f"SELECT page_id, {sql} AS value FROM pages")(lambda spark, sf: views.table(spark, sf, "pages").select("page_id", column(F.col("url")).alias("value")))


_p = lambda n: f"regexp_extract(url, '{_PART}', {n})"
_scalar("canonical_doc_id", U.document_id, f"substr(sha256({_CANON}), 1, 12)")
_scalar("url_hash", U.url_hash, f"sha256({_CANON})")
_scalar("map_doc_id", U.map_document_id, "'map_' || sha1(url)")
_scalar("fetch_doc_id", U.fetch_document_id, "substr(sha256(url), 1, 16)")
_scalar("url_normalize_engine", U.normal_feed, f"lower({_p(1)}) || '://' || lower({_p(2)}) || regexp_replace({_p(3)}, '/+$', '') || {_p(4)}")
_scalar("url_normalize_map", U.normal_map, f"{_p(1)} || '://' || lower({_p(2)}) || {_p(3)} || {_p(4)} || {_p(5)}")
_scalar("url_normalize_analytics", U.normal_analytics, f"replace({_p(2)}, 'www.', '') || regexp_replace({_p(3)}, '/+$', '')")
_scalar("url_domain", U.domain, f"lower({_p(2)})")
_scalar("url_internal", lambda u: U.is_internal(u, F.lit("https://spam-farm.example.org/x")), f"lower({_p(2)}) = 'spam-farm.example.org'")
_scalar("url_depth", lambda u: U.depth(u, F.lit("https://example.com/en/")), f"CASE WHEN list_filter(string_split({_p(3)}, '/'), lambda s: s <> '')[1] = 'en' THEN -1 ELSE 0 END + len(list_filter(string_split({_p(3)}, '/'), lambda s: s <> ''))")
_scalar("url_content_path", U.content_path, f"{_p(2)} || '/' || regexp_replace(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(CASE WHEN regexp_replace({_p(3)}, '^/+|/+$', '', 'g') = '' THEN 'index' ELSE regexp_replace({_p(3)}, '^/+|/+$', '', 'g') END, '\\.html?$', ''), '[^A-Za-z0-9_/.-]', '_', 'g'), '__+', '_', 'g'), '/'), lambda s: regexp_replace(s, '^_+|_+$', '', 'g')), '/'), '/+', '/', 'g'), '^/|/$', '', 'g') || '.md'")
_scalar("id_path", U.id_path, "substr(md5(url), 1, 2) || '/' || substr(md5(url), 3, 2) || '/' || right(translate(url, '/:?', '___'), 100) || '.md'")
_scalar("url_platform", U.platform, "CASE WHEN contains(lower(url), 'twitter.com') OR contains(lower(url), 'x.com') THEN 'twitter' WHEN contains(lower(url), 'linkedin.com') THEN 'linkedin' END")
_scalar("pattern_specificity", U.pattern_specificity, "length(translate(url, '*?', ''))")
_scalar("html_title", lambda u: V.html_title(F.col("html")), "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_scalar("content_hash", lambda u: F.sha2(F.col("html"), 256), "sha256(html)")
_scalar("bytes_fetched", lambda u: F.octet_length(F.col("html")).cast("bigint"), "strlen(html)")
_scalar("item_id_fallback", lambda u: V.item_id(u, F.col("html")), "substr(md5(url || substr(html, 1, 100)), 1, 12)")
_scalar("item_title", lambda u: V.item_title(F.lit(None).cast("string"), F.col("html"), u), "coalesce(nullif(substr(trim(string_split(html, chr(10))[1]), 1, 200), ''), nullif(url, ''), 'Untitled')")
_scalar("status_from_error", lambda u: V.status_from_error(F.when(F.col("page_id") % 2 == 0, "").otherwise(u)), "CASE WHEN page_id % 2 = 0 THEN 'SUCCESS' ELSE 'ERROR' END")
_scalar("source_identifier", lambda u: V.source_identifier(F.lit(""), F.when(F.col("page_id") % 2 == 0, u), F.lit("x")), "CASE WHEN page_id % 2 = 0 THEN url ELSE 'x' END")
_scalar("text_truncate", lambda u: F.substring(F.col("html"), 1, 500), "substr(html, 1, 500)")
_scalar("cms_address_slug", lambda u: V.cms_address(F.regexp_replace(u, "^https?://", ""))["slug"], r"array_to_string((string_split(regexp_replace(url, '^https?://', ''), '/'))[CASE WHEN len(string_split(regexp_replace(url, '^https?://', ''), '/')) >= 4 THEN 4 ELSE 3 END:], '/')")


# The regular expressions of this SQL are its own: pages here have no nested furniture and three kinds of inline elements.
_CONTENT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '\\s+', ' ', 'g'), '<h1>', '# ', 'g'), '</?b>', '**', 'g'), '<br>', chr(10), 'g'), '</?p>|</h1>', chr(10) || chr(10), 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')""".replace("\\\\", "\\")
_DECODED = "replace(replace(replace(replace(%s, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"


@query("page_extraction", f"""WITH c AS (SELECT page_id, nullif({_DECODED % f"trim({_CONTENT}, ' ' || chr(10))"}, '') AS content, {_DECODED % "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"} AS title FROM pages)
SELECT page_id, title, content, md5(content) AS fingerprint FROM c""")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", html.extracted(F.col("html")).alias("e")).select("page_id", "e.title", "e.content", "e.fingerprint")


@query("fetch_recorded", f"""WITH r AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN url || '#gone' ELSE url END AS asked FROM pages)
SELECT r.page_id, CASE WHEN p.url IS NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status, CASE WHEN p.url IS NULL THEN 'HTTP 404' END AS error FROM r LEFT JOIN (SELECT DISTINCT url FROM pages) p ON r.asked = p.url""")
def _(spark, sf):
    p = views.table(spark, sf, "pages")
    asked = p.select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat("url", F.lit("#gone"))).otherwise(F.col("url")).alias("source_url"))
    return providers.recorded(asked, p).select("page_id", "status", "error")


@query("html_meta", "SELECT c_custkey, c_name || ' & co' AS description, NULLIF(c_mktsegment, 'BUILDING') AS author FROM customer")
def _(spark, sf):
    c = views.table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    page = F.concat(F.lit("<head><meta charset='utf-8'><META content=\""), "c_name", F.lit(" &amp; co\" name='description'>"), F.when(seg != "BUILDING", F.concat(F.lit('<meta name="author" content="'), seg, F.lit('">'))).otherwise(""), F.lit("</head>"))
    return c.select("c_custkey", html.extracted(page).alias("e")).select("c_custkey", "e.description", "e.author")


@query("html_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM pages) SELECT page_id, pos, href FROM l""".replace("\\\\", "\\"))
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("pos", "href"))


@query("robots_filter", f"SELECT page_id, (regexp_extract(url, '{_PART}', 3) LIKE '/de/%' OR regexp_extract(url, '{_PART}', 3) LIKE '/es%') AS blocked FROM pages")
def _(spark, sf):
    rules = graph.robots_rules(F.lit("User-agent: other\nDisallow: /en\n\nUser-Agent: *\nDisallow: /DE/\nDisallow:\nDisallow: /es*\n"))
    return views.table(spark, sf, "pages").select("page_id", graph.blocked(F.col("url"), rules).alias("blocked"))


_EDGES = "g AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


@query("crawl_bfs", f"""WITH RECURSIVE {_EDGES}, b(node, depth) AS (SELECT 'r1', 0 UNION SELECT dst, depth + 1 FROM b JOIN g ON node = src WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM b GROUP BY node)
SELECT d.node, d.depth, (SELECT min(g.src) FROM g JOIN d p ON p.node = g.src WHERE g.dst = d.node AND p.depth = d.depth - 1) AS parent FROM d""")
def _(spark, sf):
    t = lambda n: views.table(spark, sf, n)
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"))
    n = t("nation")
    edges = edge(n, "r", "n_regionkey", "n", "n_nationkey").union(edge(t("customer"), "n", "c_nationkey", "c", "c_custkey")).union(edge(t("orders"), "c", "o_custkey", "o", "o_orderkey")).union(edge(n, "n", "n_nationkey", "r", "n_regionkey"))
    return graph.reach(edges, spark.createDataFrame([("r1",)], "node string"), 3)


@query("jsonpath_coalesce", """SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k FROM events""")
def _(spark, sf):
    return views.table(spark, sf, "events").select("event_id", V.first_field(F.col("props"), ["missing", "k"]).alias("k"))


# -- runs and events -----------------------------------------------------------------------------------------------------


@query("event_latest_n", f"WITH {_EVENTS} SELECT run_id, id, status, n::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS n FROM e) WHERE n <= 20")
def _(spark, sf):
    return analytics.latest_events(views.step_events(spark, sf), 20).select("run_id", "id", "status", "rank")


@query("event_cursor", f"WITH {_EVENTS} SELECT id, status FROM e WHERE run_id = 7 AND id > 500 ORDER BY id LIMIT 100")
def _(spark, sf):
    return views.step_events(spark, sf).where("run_id = 7 and id > 500").orderBy("id").limit(100).select("id", "status")


@query("event_stage", f"WITH {_EVENTS} SELECT run_id, max_by(step_id, id) AS stage FROM e WHERE status = 'view' GROUP BY run_id")
def _(spark, sf):
    return views.step_events(spark, sf).where("status = 'view'").groupBy("run_id").agg(F.max_by("step_id", "id").alias("stage"))


_STEPS = "s AS (SELECT o_custkey AS run_id, o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'failed' ELSE 'completed' END AS status, o_orderdate AS started_at, (o_orderkey % 50)::INTEGER AS output_count, (o_orderkey % 7)::INTEGER AS error_count FROM orders)"


def _steps(spark, sf):
    o = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), o.alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"), F.col("o_orderdate").alias("started_at"), (o % 50).cast("int").alias("output_count"), (o % 7).cast("int").alias("error_count"))


@query("run_status_effective", f"""WITH {_STEPS}, l AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC, id DESC) AS n FROM s)
SELECT run_id, CASE WHEN max(status) FILTER (n = 1) = 'completed' AND sum(error_count) > 0 THEN 'completed_with_errors' ELSE max(status) FILTER (n = 1) END AS status, sum(error_count)::BIGINT AS total_errors, sum(output_count)::BIGINT AS total_output, sum(greatest(0, output_count - error_count))::BIGINT AS total_success FROM l GROUP BY run_id""")
def _(spark, sf):
    return analytics.run_status(_steps(spark, sf))


@query("stale_runs", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1996-06-01 00:00:00' - INTERVAL 90 MINUTE")
def _(spark, sf):
    runs = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "running").alias("status"), F.col("o_orderdate").alias("started_at"))
    return analytics.stale_runs(runs, F.lit("1996-06-01").cast("timestamp"), 90).select("id")


@query("step_shown_status", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE event_type END AS step, upper(event_type) AS run FROM events")
def _(spark, sf):
    return views.table(spark, sf, "events").select("event_id", V.step_shown(F.col("event_type")).alias("step"), V.workflow_shown(F.col("event_type")).alias("run"))


@query("duration_ms", "SELECT o_orderkey, epoch_ms(TIMESTAMP '2000-01-01 00:00:00') - epoch_ms(o_orderdate) AS ms FROM orders")
def _(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", V.duration_ms(F.col("o_orderdate"), F.lit(None).cast("timestamp"), F.lit("2000-01-01").cast("timestamp")).alias("ms"))


# -- writes --------------------------------------------------------------------------------------------------------------

_TARGET = "t AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS score FROM supplier)"
_ROWS = "w AS (SELECT c_custkey AS id, c_name AS name FROM customer)"


def _write(spark, sf):
    target = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"))
    return target, views.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("write_insert", f"WITH {_TARGET}, {_ROWS} SELECT * FROM t UNION ALL SELECT id + 1000000, name, NULL FROM w")
def _(spark, sf):
    target, rows = _write(spark, sf)
    return tables.inserted(target, rows.withColumn("id", F.col("id") + 1000000))


@query("write_upsert", f"WITH {_TARGET}, {_ROWS} SELECT coalesce(w.id, t.id) AS id, CASE WHEN w.id IS NULL THEN t.name ELSE w.name END AS name, t.score FROM t FULL JOIN w ON t.id = w.id")
def _(spark, sf):
    return tables.upserted(*_write(spark, sf), ["id"])


@query("write_replace", f"WITH {_TARGET}, {_ROWS} SELECT * FROM t WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, name, NULL FROM w")
def _(spark, sf):
    return tables.replaced(*_write(spark, sf), ["id"])


@query("write_upsert_repeated", f"WITH {_TARGET}, w AS (SELECT c_nationkey AS id, max_by(c_name, c_custkey) AS name FROM customer GROUP BY 1) SELECT coalesce(w.id, t.id) AS id, CASE WHEN w.id IS NULL THEN t.name ELSE w.name END AS name, t.score FROM t FULL JOIN w ON t.id = w.id")
def _(spark, sf):
    rows = views.table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), "c_custkey")
    return tables.upserted(_write(spark, sf)[0], rows, ["id"], "c_custkey")


@query("write_replace_repeated", f"WITH {_TARGET}, w AS (SELECT c_nationkey AS id, max_by(c_name, c_custkey) AS name FROM customer GROUP BY 1) SELECT * FROM t WHERE id NOT IN (SELECT id FROM w) UNION ALL SELECT id, name, NULL FROM w")
def _(spark, sf):
    rows = views.table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"), "c_custkey")
    return tables.replaced(_write(spark, sf)[0], rows, ["id"], "c_custkey")


@query("write_statuses", f"WITH {_TARGET}, {_ROWS} SELECT id::VARCHAR AS row_id, CASE WHEN id IN (SELECT id FROM t) THEN 'updated' ELSE 'inserted' END AS write_status FROM w")
def _(spark, sf):
    return tables.statuses(*_write(spark, sf), ["id"]).select("row_id", "write_status")


@query("write_totals", f"WITH {_TARGET}, {_ROWS} SELECT CASE WHEN id IN (SELECT id FROM t) THEN 'updated' ELSE 'inserted' END AS write_status, count(*) AS n FROM w GROUP BY 1")
def _(spark, sf):
    return tables.statuses(*_write(spark, sf), ["id"]).groupBy("write_status").agg(F.count("*").alias("n"))


@query("tenant_filter", f"WITH {_M} SELECT document_id FROM m WHERE workspace_id = 'w1'")
def _(spark, sf):
    return views.map_documents(spark, sf).where(F.col("workspace_id") == "w1").select("document_id")


@query("schema_evolution_union", "SELECT r_regionkey AS id, r_name AS name, NULL::INTEGER AS parent FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, sf):
    r = views.table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    n = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("parent"))
    return r.unionByName(n, allowMissingColumns=True)


@query("fan_in_union", "SELECT 'customer' AS src, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier")
def _(spark, sf):
    c = views.table(spark, sf, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(views.table(spark, sf, "supplier").select(F.lit("supplier").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


@query("merge_three_way", """WITH b AS (SELECT n_nationkey AS k, n_name AS v FROM nation), o AS (SELECT k, CASE WHEN k % 4 = 0 THEN v || '!' ELSE v END AS v FROM b WHERE k <> 5), t AS (SELECT k, CASE WHEN k % 6 = 0 THEN v || '?' ELSE v END AS v FROM b WHERE k <> 8 UNION ALL SELECT 99, 'new')
SELECT coalesce(b.k, o.k, t.k) AS k, CASE WHEN o.v IS NOT DISTINCT FROM b.v THEN t.v ELSE o.v END AS v, (o.v IS DISTINCT FROM b.v AND t.v IS DISTINCT FROM b.v AND o.v IS DISTINCT FROM t.v) AS conflict FROM b FULL JOIN o ON b.k = o.k FULL JOIN t ON coalesce(b.k, o.k) = t.k""")
def _(spark, sf):
    base = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    ours = base.where("k <> 5").withColumn("v", F.when(F.col("k") % 4 == 0, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    theirs = base.where("k <> 8").withColumn("v", F.when(F.col("k") % 6 == 0, F.concat("v", F.lit("?"))).otherwise(F.col("v"))).union(spark.createDataFrame([(99, "new")], "k int, v string"))
    return tables.merged(base, ours, theirs, "k").select("k", F.get_json_object("row", "$.v").alias("v"), "conflict")


@query("embed_batch_index", "SELECT vec_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 100 AS batch FROM embeddings")
def _(spark, sf):
    e = views.table(spark, sf, "embeddings")
    return e.select("vec_id", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1) / 100).alias("batch"))


@query("embedding_pack_round_trip", "SELECT vec_id, 256::INTEGER AS bytes, TRUE AS same FROM embeddings")
def _(spark, sf):
    e = views.table(spark, sf, "embeddings").withColumn("blob", V.packed("embedding"))
    return e.select("vec_id", F.octet_length("blob").alias("bytes"), V.unpacked("blob").eqNullSafe(F.col("embedding")).alias("same"))


@query("url_normalize_strict", f"""WITH p AS (SELECT page_id, lower({_p(1)}) AS s, regexp_replace(lower({_p(2)}), CASE lower({_p(1)}) WHEN 'http' THEN ':80$' ELSE ':443$' END, '') AS h, regexp_replace({_p(3)}, '/+', '/', 'g') AS path,
  array_to_string(list_sort(list_filter(string_split(substr({_p(4)}, 2), '&'), lambda x: x <> '')), '&') AS q FROM pages)
SELECT page_id, s || '://' || h || CASE WHEN path = '' AND q = '' THEN '/' WHEN length(path) > 1 THEN coalesce(nullif(rtrim(path, '/'), ''), '/') ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END AS value FROM p""")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", U.normal_strict("url").alias("value"))


# -- runs, posts and content ------------------------------------------------------------------------------------------------

_RUNS = """r AS (SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS workflow, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'running' ELSE 'completed' END AS status, o_orderdate AS started_at,
  CASE WHEN o_orderkey % 3 = 0 THEN '{"workflow_type": "tool", "parent_workflow_id": "p' || o_orderkey % 5 || '"}' WHEN o_orderkey % 3 = 1 THEN '{"workflow_type": "agent"}' END AS metadata_json FROM orders)"""


def _runs(spark, sf):
    k = F.col("o_orderkey")
    meta = F.when(k % 3 == 0, F.concat(F.lit('{"workflow_type": "tool", "parent_workflow_id": "p'), (k % 5).cast("string"), F.lit('"}'))).when(k % 3 == 1, '{"workflow_type": "agent"}')
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return views.table(spark, sf, "orders").select(k.cast("string").alias("id"), F.col("o_orderpriority").alias("workflow"), status.alias("status"), F.col("o_orderdate").alias("started_at"), meta.alias("metadata_json"))


@query("run_list_filter", f"""WITH {_RUNS}, p AS (SELECT * FROM r WHERE status IN ('pending', 'running', 'canceling') AND (id LIKE '%7%' OR workflow LIKE '%7%') ORDER BY started_at DESC NULLS LAST, id LIMIT 200 OFFSET 10)
SELECT id, workflow FROM p WHERE json_extract_string(metadata_json, '$.parent_workflow_id') IS NULL AND json_extract_string(metadata_json, '$.workflow_type') = 'agent'""")
def _(spark, sf):
    return runs.listed(_runs(spark, sf), "pending", "7", "agent", n=200, offset=10).select("id", "workflow")


@query("run_children", f"WITH {_RUNS}, p AS (SELECT * FROM r WHERE status = 'failed' ORDER BY started_at DESC NULLS LAST, id LIMIT 300) SELECT id FROM p WHERE json_extract_string(metadata_json, '$.parent_workflow_id') = 'p2'")
def _(spark, sf):
    return runs.listed(_runs(spark, sf), "ERROR", parent="p2", n=300).select("id")


@query("run_by_prefix", f"WITH {_RUNS} SELECT id, status FROM r WHERE id LIKE '12%' ORDER BY id <> '12', id LIMIT 1")
def _(spark, sf):
    return runs.by_prefix(_runs(spark, sf), "12").select("id", "status")


@query("run_output_summary", f"WITH {_STEPS} SELECT run_id, nullif(sum(output_count), 0)::BIGINT AS total_output, nullif(sum(greatest(0, output_count - error_count)), 0)::BIGINT AS total_success, nullif(sum(error_count), 0)::BIGINT AS total_errors FROM s GROUP BY run_id")
def _(spark, sf):
    return runs.outputs(_steps(spark, sf))


@query("run_correlation", f"""WITH {_EVENTS}, {_STEPS}, u AS (SELECT DISTINCT run_id AS id FROM e), l AS (SELECT run_id, least(count(*), 20) AS events FROM e GROUP BY run_id), k AS (SELECT run_id, count(*) AS steps FROM s GROUP BY run_id)
SELECT u.id, coalesce(k.steps, 0) AS steps, l.events FROM u LEFT JOIN k ON k.run_id = u.id LEFT JOIN l ON l.run_id = u.id""")
def _(spark, sf):
    e = views.step_events(spark, sf)
    rows = runs.correlated(e.select(F.col("run_id").alias("id")).distinct(), _steps(spark, sf), e)
    return rows.select("id", F.coalesce(F.size("steps"), F.lit(0)).cast("bigint").alias("steps"), F.size("events").cast("bigint").alias("events"))


@query("metadata_merge", """SELECT event_id, json_extract_string(json_merge_patch(props, '{"k": "new", "z": "1"}'), '$.k') AS k, '1' AS z, json_extract_string(json_merge_patch('{"a": "old"}', props), '$.a') AS a FROM events""")
def _(spark, sf):
    e = views.table(spark, sf, "events")
    one, two = runs.merged_metadata(F.col("props"), F.lit('{"k": "new", "z": "1"}')), runs.merged_metadata(F.lit('{"a": "old"}'), F.col("props"))
    return e.select("event_id", F.get_json_object(one, "$.k").alias("k"), F.get_json_object(one, "$.z").alias("z"), F.get_json_object(two, "$.a").alias("a"))


def _posts(spark, sf):
    d = views.table(spark, sf, "documents").where("text is not null")
    post = F.struct(F.col("doc_id").cast("string").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), F.concat(F.lit("/r/"), "source").alias("permalink"), F.col("text").alias("selftext"), (F.col("doc_id") * 3600.0).alias("created_utc"), F.col("lang").alias("author"), (F.col("n_chars") % 300).cast("int").alias("score"), (F.col("doc_id") % 90).cast("int").alias("num_comments"))
    return d.select(F.to_json(post).alias("value"), "source")


_POSTS = "p AS (SELECT 'reddit_' || doc_id AS signal_id, lang || ' ' || source AS title, nullif(substr(text, 1, 500), '') AS snippet, (n_chars % 300)::INTEGER AS score, (doc_id % 90)::INTEGER AS comment_count, source AS subreddit, make_timestamp(doc_id * 3600000000) AS timestamp, ['http', 'and', 'LIZENZ'] AS k FROM documents WHERE text IS NOT NULL)"


@query("signals_posts", f"""WITH {_POSTS}, f AS (SELECT *, list_filter(k, lambda w: contains(lower(title), lower(w)) OR contains(lower(coalesce(snippet, '')), lower(w))) AS found FROM p WHERE score >= 50)
SELECT signal_id, subreddit, score, comment_count, length(snippet) AS snippet_length, array_to_string(found, ',') AS keywords FROM f WHERE len(found) > 0""")
def _(spark, sf):
    rows = signals.posts(_posts(spark, sf), F.col("source"), ["http", "and", "LIZENZ"], 50)
    return rows.select("signal_id", "subreddit", "score", "comment_count", F.length("snippet").cast("bigint").alias("snippet_length"), F.array_join("keywords", ",").alias("keywords"))


@query("signals_recent_ranked", f"WITH {_POSTS} SELECT signal_id, {_REL.replace('comments', 'comment_count')} AS relevance FROM p WHERE timestamp >= TIMESTAMP '1970-02-08 00:00:00' - INTERVAL 168 HOUR ORDER BY relevance DESC, signal_id LIMIT 30")
def _(spark, sf):
    rows = signals.recent(signals.posts(_posts(spark, sf), F.col("source")), F.lit("1970-02-08").cast("timestamp"), "week")
    return signals.ranked(rows, 30).select("signal_id", "relevance")


def _cms(spark, sf):
    d = views.table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(F.concat(F.when(k % 4 == 0, "drafts.").otherwise(""), k.cast("string")).alias("_id"), F.col("lang").alias("_type"), F.lpad((k * 7 % 1000).cast("string"), 4, "0").alias("_updatedAt"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("body"), F.array(F.col("source"), F.lit("all")).alias("tags"))


_CMS = "c AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'drafts.' ELSE '' END || doc_id AS _id, lang AS _type, lpad((doc_id * 7 % 1000)::VARCHAR, 4, '0') AS _updatedAt, lang || ' ' || source AS title, text AS body, [source, 'all'] AS tags FROM documents)"


@query("cms_types", f"WITH {_CMS} SELECT _type, count(*) AS n FROM c GROUP BY _type")
def _(spark, sf):
    return cms.types(_cms(spark, sf))


@query("cms_search", f"""WITH {_CMS} SELECT _id, title, CASE WHEN starts_with(_id, 'drafts.') THEN 'draft' ELSE 'published' END AS status FROM c
WHERE _type = 'en' AND (contains(lower(title), 'the') OR contains(lower(body), 'the')) AND list_contains(tags, 'src0') AND _updatedAt > '0200' ORDER BY _updatedAt DESC, _id LIMIT 40""")
def _(spark, sf):
    return cms.search(_cms(spark, sf), "The", {"tags": ["src0"], "_updatedAt": ">0200"}, "en", 40).select("_id", "title", "status")


@query("content_accepted", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Unsupported content type: image/png' END AS error, CASE WHEN page_id % 3 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status FROM pages")
def _(spark, sf):
    p = views.table(spark, sf, "pages").select("page_id", F.col("html").alias("content"), F.when(F.col("page_id") % 3 == 0, "image/png").otherwise("Text/HTML; charset=utf-8").alias("content_type"))
    return accepted(p).select("page_id", "error", "status")


@query("post_markdown", """SELECT o_orderkey, '# Tweet by ' || o_orderpriority || ' (@u' || o_custkey || ')' || CASE WHEN o_orderkey % 2 = 0 THEN ' ✓' ELSE '' END || chr(10) || chr(10) || '**URL:** https://x.com/' || o_orderkey || chr(10) || chr(10) || 'text'
  || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE chr(10) || chr(10) || '**Engagement:** ' || format('{:,}', o_orderkey % 5 * 1000) || ' likes' END AS value FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    made = markdown.post(F.col("o_orderpriority"), F.concat(F.lit("u"), F.col("o_custkey").cast("string")), k % 2 == 0, F.lit(None).cast("string"), F.concat(F.lit("https://x.com/"), k.cast("string")), F.lit("text"), {"likes": k % 5 * 1000, "replies": F.lit(0)})
    return views.table(spark, sf, "orders").select("o_orderkey", made.alias("value"))


@query("citations", f"SELECT page_id, 'Source 1' AS title, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS domain FROM pages")
def _(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", F.inline(markdown.citations(F.array("url")))).select("page_id", "title", "domain")


@query("cost_by_engine", "SELECT source AS engine, sum(n_chars)::BIGINT AS units, count(*) AS calls, count(*) FILTER (n_chars = 0) AS failed FROM documents GROUP BY source")
def _(spark, sf):
    d = views.table(spark, sf, "documents").groupBy(F.col("source").alias("engine"))
    return d.agg(F.sum("n_chars").alias("units"), F.count("*").alias("calls"), F.count(F.when(F.col("n_chars") == 0, 1)).alias("failed"))


@query("tenant_fill", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'w9' END AS workspace_id, 'u9' AS user_id FROM customer")
def _(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("workspace_id"))
    return tables.tenant_filled(c, workspace_id="w9", user_id="u9")


# -- SQL through the guarded entry -----------------------------------------------------------------------------------------

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _sql(name: str, text: str, oracle: str | None = None, **params) -> None:
    """A query by named parameters over the test tables."""

    def run(spark, sf):
        return run_sql(spark, text, params, {t: views.table(spark, sf, t) for t in _TABLES if f" {t}" in text or f"({t}" in text})

    bound = oracle or text
    for k, v in params.items():
        bound = bound.replace(f":{k}", f"'{v}'" if isinstance(v, str) else str(v))
    query(f"sql_{name}", bound)(run)


_sql("project_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '1%' AND o_totalprice BETWEEN :low AND :high", low=1000, high=90000)
_sql("limit_parameter", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = :segment ORDER BY c_custkey LIMIT :n", segment="BUILDING", n=7)
# Customers are counted for each nation before suppliers meet them: the pairs of a nation grow with the square of the tables.
_sql(
    "joins",
    "SELECT n.n_name, coalesce(sum(c.customers), 0) AS customers, count(DISTINCT s.s_suppkey) AS suppliers FROM nation n LEFT JOIN (SELECT c_nationkey, count(c_custkey) AS customers FROM customer GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
    "SELECT n.n_name, count(c.c_custkey) AS customers, count(DISTINCT s.s_suppkey) AS suppliers FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey FULL JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name",
)
_sql("semi_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS buys FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_sql("theta_join", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey AND o_totalprice > c_acctbal * :times", times=30)
_sql("cross_join", "SELECT r_name, p_size, count(*) AS n FROM region CROSS JOIN (SELECT DISTINCT p_size FROM part) s GROUP BY r_name, p_size")
_sql("range_join", "SELECT b.low, count(o_orderkey) AS n FROM (SELECT n_nationkey * 15000 AS low, n_nationkey * 15000 + 15000 AS high FROM nation) b LEFT JOIN orders ON o_totalprice >= b.low AND o_totalprice < b.high GROUP BY b.low")
_sql("as_of_join", "SELECT o_orderkey, max(e.ts) AS seen FROM orders JOIN (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id) e ON o_custkey = e.user_id AND e.ts >= o_orderdate GROUP BY o_orderkey")
_sql("interval_join", "SELECT a.user_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.event_id <= a.event_id + 50 GROUP BY a.user_id")
_sql("percentile", "SELECT o_orderpriority, percentile(o_totalprice, 0.5) AS mid, percentile(o_totalprice, 0.9) AS high FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, quantile_cont(o_totalprice, 0.5) AS mid, quantile_cont(o_totalprice, 0.9) AS high FROM orders GROUP BY o_orderpriority")
_sql("recursive_cte", "SELECT n, total FROM (WITH RECURSIVE s(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM s WHERE n < 40) SELECT n, total FROM s) r")
_sql("arrays_maps_structs", "SELECT l_orderkey, size(collect_set(l_returnflag)) AS flags, array_join(sort_array(collect_set(l_linestatus)), ',') AS marks, max(named_struct('n', l_linenumber, 'q', l_quantity)).q AS q, map('a', count(*))['a'] AS n FROM lineitem GROUP BY l_orderkey", "SELECT l_orderkey, count(DISTINCT l_returnflag)::INTEGER AS flags, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS marks, max({'n': l_linenumber, 'q': l_quantity}).q AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey")
_sql("group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > :least", least=10)
_sql("distinct_stats", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY o_orderpriority")
_sql("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) + 0 AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("cube", "SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
_sql("window_rank", "SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS prev, sum(o_shippriority) OVER w AS s FROM (SELECT *, 1 AS o_shippriority FROM orders) t WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_sql("window_frame", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS n, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS f FROM events")
_sql("order_nulls_offset", "SELECT doc_id, nullif(lang, 'en') AS l FROM documents ORDER BY l DESC NULLS LAST, doc_id LIMIT 30 OFFSET 10")
_sql("set_operations", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region EXCEPT SELECT 7 INTERSECT SELECT 7")
_sql("subquery_cte", "SELECT t.o_custkey, t.total FROM (WITH s AS (SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey) SELECT * FROM s) t WHERE t.total = (SELECT max(c) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey) m)")
_sql("case_string_date", "SELECT o_orderkey, CASE WHEN o_totalprice > 1000 THEN upper(o_orderpriority) ELSE 'small' END AS size, year(o_orderdate) AS y, substring(o_orderpriority, 1, 3) AS p, abs(o_totalprice - 5) AS a FROM orders")
_sql("json_property", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY get_json_object(props, '$.k') ORDER BY n DESC, k LIMIT 20", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, k LIMIT 20")
_sql("prefix", "SELECT p_partkey FROM part WHERE p_brand LIKE concat(:start, '%')", start="Brand#1")
_sql("ilike", "SELECT page_id FROM pages WHERE url ILIKE '%EXAMPLE.ORG%'")
