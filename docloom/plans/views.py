"""The registry's tables as views over the driver's test tables; nothing reads the clock."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import document_id
from ..functions.values import html_title

START = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{found or tempfile.mkdtemp(prefix='docloom-')}/{uuid.uuid4().hex}"


def map_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    n = F.col("page_id")
    failed = n % 7 == 0
    return p.select(
        document_id(F.col("url")).alias("document_id"),
        n,
        F.col("url").alias("source_url"),
        F.when(n % 11 == 0, "file").otherwise("url").alias("source_type"),
        F.element_at(F.array(F.lit("sitemap"), F.lit("crawl"), F.lit("rss")), (n % 3 + 1).cast("int")).alias("discovery_method"),
        F.lit(None).cast("string").alias("discovery_url"),
        F.when(failed, "ERROR").otherwise("SUCCESS").alias("status"),
        html_title(F.col("html")).alias("title"),
        F.when(failed, "Invalid URL format").alias("error"),
        F.concat(F.lit("u"), (n % 5).cast("string")).alias("user_id"),
        F.concat(F.lit("w"), (n % 4).cast("string")).alias("workspace_id"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), n.cast("int"))).alias("created_at"),
    )


def fetch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch rows of the documents that stand for fetched ones: those in German haven't been."""
    d = table(spark, sf_dir, "documents").where("lang <> 'de'").select("doc_id", "n_chars", "source", "text")
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    kind = F.col("doc_id") % 5
    status = F.when(kind == 3, "ERROR").when(kind == 4, "PENDING").otherwise("SUCCESS")
    return d.join(p, d["doc_id"] == p["page_id"]).select(
        document_id(F.col("url")).alias("document_id"),
        status.alias("status"),
        F.when(kind < 3, F.col("n_chars")).otherwise(0).cast("int").alias("content_length"),
        F.sha2("text", 256).alias("content_hash"),
        F.col("source").alias("fetch_engine"),
        F.when(kind == 3, F.when(F.col("doc_id") % 2 == 0, "403 Forbidden").otherwise("")).alias("error"),
    )


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.concat(F.lit("step"), (F.col("event_id") % 4).cast("string")).alias("step_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"), F.col("value").alias("current"), F.col("props").alias("metadata_json"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, from conversations: the model is the role, a turn's length its tokens."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("workflow_id"),
        F.col("turn"),
        F.coalesce("role", F.lit("none")).alias("model"),
        F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("input_tokens"),
        (F.col("turn") * 10).cast("bigint").alias("output_tokens"),
        F.when(F.col("turn") % 3 > 0, F.col("turn") * 100).cast("bigint").alias("latency_ms"),
    )


def pageviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(url, ts, user_id)``: events of one type on the pages' addresses in turn."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    e = table(spark, sf_dir, "events").where("event_type = 'view'").select("ts", "user_id", (F.col("event_id") % pages.agg(F.count("*")).scalar()).alias("n"))
    return e.join(pages, F.col("n") == F.col("page_id")).select("url", "ts", "user_id")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit(" by "), F.coalesce("source", F.lit(""))).alias("title"), F.col("text").alias("snippet"), (F.col("n_chars") % 500).alias("score"), (F.col("doc_id") % 70).alias("comments"), F.col("source").alias("subreddit"))
