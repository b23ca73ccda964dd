"""Monitoring signals from posts in JSON: scores, keywords, recency, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import citation_domain, matched_keywords, relevance

#: Hours of a time frame.
HOURS = {"hour": 1, "day": 24, "week": 168, "month": 720}
POST = "id string, title string, permalink string, selftext string, created_utc double, author string, score int, num_comments int"
FEED = "id string, title string, link string, summary string, published timestamp, author string"


def posts(raw: DataFrame, subreddit: Column, keywords: list[str] | None = None, min_score: int = 0) -> DataFrame:
    """Signals of posts ``raw(value)`` in JSON: score filter, snippets of 500 characters, keywords in title or snippet."""
    p = raw.select(F.from_json("value", POST).alias("p"), subreddit.alias("subreddit")).select("p.*", "subreddit").where(F.coalesce("score", F.lit(0)) >= min_score)
    rows = p.select(
        F.concat(F.lit("reddit_"), "id").alias("signal_id"),
        F.lit("reddit").alias("source"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.concat(F.lit("https://reddit.com"), F.coalesce("permalink", F.lit(""))).alias("url"),
        F.nullif(F.substring("selftext", 1, 500), F.lit("")).alias("snippet"),
        F.timestamp_micros((F.coalesce("created_utc", F.lit(0.0)) * 1_000_000).cast("bigint")).alias("timestamp"),
        "author",
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("num_comments", F.lit(0)).alias("comment_count"),
        "subreddit",
    )
    return with_keywords(rows, keywords or [])


def with_keywords(signals: DataFrame, keywords: list[str]) -> DataFrame:
    """Signals with the keywords that they match; with keywords given, those without any go."""
    rows = signals.withColumn("keywords", matched_keywords(keywords, F.col("title"), F.col("snippet")))
    return rows.where(F.size("keywords") > 0) if keywords else rows


def recent(signals: DataFrame, as_of: Column, frame: str) -> DataFrame:
    return signals.where(F.col("timestamp") >= as_of - F.make_dt_interval(F.lit(0), F.lit(HOURS[frame])))


def ranked(signals: DataFrame, n: int | None = None) -> DataFrame:
    """By relevance, ties by id."""
    rows = signals.withColumn("relevance", relevance(F.col("score"), F.col("comment_count"))).orderBy(F.desc("relevance"), "signal_id")
    return rows.limit(n) if n else rows


def feed_items(raw: DataFrame, since: Column | None = None) -> DataFrame:
    """Signals of feed entries ``raw(value)`` in JSON, newest first; ids are hashes of the link."""
    p = raw.select(F.from_json("value", FEED).alias("p")).select("p.*")
    if since is not None:
        p = p.where(F.col("published") >= since)
    rows = p.select(F.concat(F.lit("feed_"), F.substring(F.sha2("link", 256), 1, 16)).alias("signal_id"), "title", F.col("link").alias("url"), F.substring("summary", 1, 500).alias("snippet"), F.col("published").alias("timestamp"), "author", citation_domain(F.col("link")).alias("domain"))
    return rows.orderBy(F.col("timestamp").desc_nulls_last(), "signal_id")
