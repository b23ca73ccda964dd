"""Registered queries of paged listings, table functions and aggregates in Python, sketches of days, progress and totals, with their SQL."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.url import normal_analytics
from ..operators import analytics
from ..operators.aggregates import Aggregate
from ..sinks import content
from ..sources import listings, pages
from ..workflow import run as workflow
from . import views
from .catalog import _EVENTS, _TRACES, _VIEWS60, query

_ITEM = "id bigint, title string, content_type string, slug string, status string"
_ITEMS = "i AS (SELECT doc_id AS id, substr(text, 1, 40) AS title, lang AS content_type, CASE WHEN doc_id % 9 > 0 THEN source || '-' || doc_id END AS slug, CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'published' END AS status FROM documents)"


def _listing(spark, sf) -> str:
    """All documents recorded as a listing; the name of its source."""
    items = views.table(spark, sf, "documents").select(
        F.col("doc_id").cast("bigint").alias("id"),
        F.substring("text", 1, 40).alias("title"),
        F.col("lang").alias("content_type"),
        F.when(F.col("doc_id") % 9 > 0, F.concat("source", F.lit("-"), "doc_id")).alias("slug"),
        F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("published").alias("status"),
    )
    folder, name = views.new_folder(spark), f"listing_{uuid.uuid4().hex}"
    listings.record(items, folder, "id", 1000)
    spark.dataSource.register(listings.source(listings.Recorded(folder, "id", 1000, {"content_type", "status"}), _ITEM, name, 8))
    return name


@query("listing_documents", f"WITH {_ITEMS} SELECT 'cms/main/en/' || coalesce(slug, 'untitled') AS url, title, id AS cms_id, content_type AS schema, slug FROM i WHERE content_type = 'en' AND status = 'published'")
def listing_documents(spark, sf):
    return listings.documents(spark, _listing(spark, sf), "cms", "main", "en", "published")


@query("listing_fetch", f"WITH {_ITEMS} SELECT * FROM i WHERE id IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def listing_fetch(spark, sf):
    """The listed items whose id is that of some purchase."""
    ids = views.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    return listings.fetched(listings.scan(spark, _listing(spark, sf)), ids).select("id", "title", "content_type", "slug", "status")


@query("listing_stream", f"WITH {_ITEMS} SELECT content_type, count(*) AS n, sum(id)::BIGINT AS ids, max(title) AS title FROM i WHERE status = 'draft' GROUP BY content_type")
def listing_stream(spark, sf):
    """The drafts of a listing, followed by a stream up to the last id and then counted."""
    items, folder = listings.scan(spark, _listing(spark, sf), [("status", "=", "draft")], stream=True), views.new_folder(spark)
    to = items.writeStream.format("parquet").option("path", f"{folder}/items").option("checkpointLocation", f"{folder}/state")
    to.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(_ITEM).parquet(f"{folder}/items").groupBy("content_type").agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.max("title").alias("title"))


@F.udtf(returnType="user_id bigint, session int, events bigint, started timestamp, ended timestamp")
class Sessions:
    """A user's events in order of time as sessions: one ends where nothing follows for ``minutes``."""

    def __init__(self):
        self.session, self.open = 0, None

    def eval(self, row, minutes):
        if self.open and (row["ts"] - self.open[3]).total_seconds() <= 60 * minutes:
            self.open = (*self.open[:1], self.open[1] + 1, self.open[2], row["ts"])
            return
        yield from self.terminate()
        self.session += 1
        self.open = (row["user_id"], 1, row["ts"], row["ts"])

    def terminate(self):
        if self.open:
            user, n, started, ended = self.open
            yield user, self.session, n, started, ended


_SESSIONS = """
[inputs.minutes]
type = "int"
default = 720
[steps.events]
type = "table"
config = { name = "events" }
[steps.sessions]
type = "table-function"
depends_on = ["events"]
function = "sessions"
config = { partition_by = "user_id", order_by = ["ts"], params = { minutes = "{{minutes}}" } }
"""


@query(
    "workflow_table_function",
    """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 720 * 60000000::BIGINT, true)::INT AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts)::INT AS session FROM g)
    SELECT user_id, session, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY user_id, session""",
)
def workflow_table_function(spark, sf):
    events = views.table(spark, sf, "events").select(F.col("user_id").cast("bigint").alias("user_id"), "ts")
    return workflow.run(spark, workflow.parse(_SESSIONS), {}, {"events": events}, {"sessions": Sessions})["sessions"]


def longest(n: int) -> Aggregate:
    """Number of a group's documents and the ``n`` longest, ties by id."""

    def top(pairs) -> list:
        return sorted(pairs, key=lambda p: (-p["n_chars"], p["doc_id"]))[:n]

    def add(rows: pa.Table) -> dict:
        return {"n": len(rows), "top": top(rows.select(["n_chars", "doc_id"]).to_pylist())}

    def merge(states: list[dict]) -> dict:
        return {"n": sum(s["n"] for s in states), "top": top(p for s in states for p in s["top"])}

    return Aggregate("n bigint, top array<struct<n_chars: bigint, doc_id: bigint>>", "n bigint, longest string", add, merge, lambda s: {"n": s["n"], "longest": ",".join(str(p["doc_id"]) for p in s["top"])})


_LONGEST = """
[steps.documents]
type = "table"
config = { name = "documents" }
[steps.longest]
type = "aggregate"
depends_on = ["documents"]
function = "longest"
config = { group_by = ["source", "lang"] }
"""


@query(
    "workflow_aggregate",
    """SELECT source, lang, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY place) FILTER (place <= 3) AS longest
    FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS place FROM documents) GROUP BY source, lang""",
)
def workflow_aggregate(spark, sf):
    documents = views.table(spark, sf, "documents").select("source", "lang", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("n_chars").cast("bigint").alias("n_chars"))
    return workflow.run(spark, workflow.parse(_LONGEST), {}, {"documents": documents}, {"longest": longest(3)})["longest"]


@query("quantile_sketches", "SELECT event_type, count(value) AS n, true AS close FROM events GROUP BY event_type")
def quantile_sketches(spark, sf):
    """Values of each type from daily sketches: whether quartiles and the 99th percentile have ranks within 0.03 of what was asked for."""
    events, wanted = views.table(spark, sf, "events"), [0.25, 0.5, 0.75, 0.99]
    found = analytics.quantile_estimates(analytics.quantile_sketches(events, ["event_type"], "ts", "value"), ["event_type"], wanted)
    # equal values share a range of ranks; the one asked for has to lie within or near it
    below = [F.avg((F.col("value") < F.col("quantiles")[k]).cast("int")).alias(f"below{k}") for k in range(4)]
    upto = [F.avg((F.col("value") <= F.col("quantiles")[k]).cast("int")).alias(f"upto{k}") for k in range(4)]
    ranks = events.join(found, "event_type").groupBy("event_type").agg(F.max("n").alias("n"), *below, *upto)
    close = [(F.col(f"below{k}") <= q + 0.03) & (F.col(f"upto{k}") >= q - 0.03) for k, q in enumerate(wanted)]
    return ranks.select("event_type", "n", (close[0] & close[1] & close[2] & close[3]).alias("close"))


@query("visitor_windows", f"WITH {_VIEWS60} SELECT url, pageviews_60d, pageviews_30d, pageviews_previous_30d, pageviews_trend, trend_percentage, true AS close FROM a")
def visitor_windows(spark, sf):
    """Traffic windows from what each day adds; visitors of the whole period within five per cent, or one, of the exact count."""
    seen, as_of = views.pageviews(spark, sf), F.lit("2024-01-31").cast("timestamp")
    found = analytics.visitor_windows(analytics.pageview_sketches(seen, "user_id"), as_of, 30)
    some = seen.where("ts >= '2024-01-01' and ts < '2024-01-31'").groupBy(normal_analytics(F.col("url")).alias("url")).agg(F.countDistinct("user_id").alias("exact"))
    near = F.abs(F.col("visitors_60d") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))
    return found.join(some, "url").select("url", "pageviews_60d", "pageviews_30d", "pageviews_previous_30d", "pageviews_trend", "trend_percentage", near.alias("close"))


_COUNTED = "c AS (SELECT run_id, id, step_id, round(current)::BIGINT AS current, CASE WHEN id % 3 = 0 THEN 500 END AS total, CASE WHEN id % 3 = 1 THEN id % 7 END AS inner_current, row_number() OVER (PARTITION BY run_id ORDER BY id DESC) AS n FROM e)"


@query(
    "event_progress",
    f"""WITH {_EVENTS}, {_COUNTED},
    p AS (SELECT run_id, max_by({{'current': CASE WHEN total IS NOT NULL THEN current ELSE inner_current END, 'total': coalesce(total, 90), 'step': step_id}}, id) FILTER (n <= 20 AND (total IS NOT NULL OR inner_current IS NOT NULL)) AS f FROM c GROUP BY run_id),
    s AS (SELECT run_id, max_by(step_id, id) AS name FROM e WHERE status = 'signup' AND run_id % 2 = 0 GROUP BY run_id)
    SELECT run_id, coalesce(name, f.step) AS stage, coalesce(f.current, 0)::BIGINT AS current, coalesce(f.total, 0)::BIGINT AS total FROM p LEFT JOIN s USING (run_id)""",
)
def event_progress(spark, sf):
    """Progress of every run: a third of the events has both counters in columns, a third in the metadata."""
    e = views.step_events(spark, sf)
    inner = F.when(F.col("id") % 3 == 1, F.to_json(F.struct((F.col("id") % 7).alias("current"), F.lit(90).alias("total"))))
    events = e.select("run_id", "id", "step_id", F.round("current").cast("bigint").alias("current"), F.when(F.col("id") % 3 == 0, 500).alias("total"), inner.alias("metadata_json"))
    steps = e.where("status = 'signup' and run_id % 2 = 0").select("run_id", F.col("step_id").alias("name"), F.lit("running").alias("status"), F.col("id").alias("position"))
    return analytics.progress(events, steps)


@query(
    "enrichment_totals",
    f"WITH {_TRACES} SELECT count(*) AS total, count(*) FILTER (latency_ms IS NOT NULL) AS success, count(*) FILTER (latency_ms IS NULL) AS failed, sum(input_tokens)::BIGINT AS tokens_in, sum(output_tokens)::BIGINT AS tokens_out FROM t",
)
def enrichment_totals(spark, sf):
    """Totals of calls; one without a latency has failed."""
    status = F.when(F.col("latency_ms").isNotNull(), "success").otherwise("error")
    return analytics.batch_totals(views.traces(spark, sf).select(status.alias("_status"), F.col("input_tokens").alias("_tokens_in"), F.col("output_tokens").alias("_tokens_out")))


@query("trace_rows", f"WITH {_TRACES} SELECT workflow_id, turn, model, 'local' AS provider, input_tokens, coalesce(CASE WHEN turn % 2 = 0 THEN output_tokens END, 0) AS output_tokens, input_tokens + coalesce(CASE WHEN turn % 2 = 0 THEN output_tokens END, 0) AS total_tokens, CASE WHEN turn % 3 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS cost FROM t")
def trace_rows(spark, sf):
    calls = views.traces(spark, sf).select("workflow_id", "turn", "model", F.lit("local").alias("provider"), "input_tokens", F.when(F.col("turn") % 2 == 0, F.col("output_tokens")).alias("output_tokens"), F.when(F.col("turn") % 3 == 0, F.lit(0.5)).alias("cost"))
    return content.trace_rows(calls)


@query(
    "sitemaps_expanded",
    """SELECT 'https://maps.test/' || s AS sitemap, CASE WHEN s % 11 = 1 OR s % 7 = 0 THEN 0 ELSE n END::BIGINT AS n, CASE WHEN s % 11 = 1 THEN 'no text' WHEN s % 7 = 0 THEN 'invalid XML' END AS error
    FROM (SELECT page_id // 10 AS s, count(*) AS n FROM pages GROUP BY 1)""",
)
def sitemaps_expanded(spark, sf):
    """Sitemaps of ten pages each under indexes of a hundred; of some the text is broken or missing."""
    found = views.table(spark, sf, "pages").select(F.floor(F.col("page_id") / 10).alias("s"), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")).alias("url"))
    address = F.concat(F.lit("https://maps.test/"), F.col("s").cast("string"))
    listed = found.groupBy("s").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc>"), "url", F.lit("</loc></url>"))), "")).alias("xml"))
    maps = listed.where("s % 11 <> 1").select(address.alias("url"), F.when(F.col("s") % 7 == 0, F.col("xml")).otherwise(F.concat("xml", F.lit("</urlset>"))).alias("xml"))
    index = listed.groupBy(F.concat(F.lit("https://index.test/"), F.floor(F.col("s") / 100).cast("string")).alias("url"))
    index = index.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), address, F.lit("</loc></sitemap>"))), ""), F.lit("</sitemapindex>")).alias("xml"))
    rows = pages.sitemaps_expanded(index.select("url"), index.unionByName(maps))
    return rows.groupBy("sitemap", "error").agg(F.count("loc").alias("n")).select("sitemap", "n", "error")
