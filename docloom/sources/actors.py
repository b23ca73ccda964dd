"""Items of scraping services: field mappings as a table, parsed posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

#: The names under which services give a field, first one first.
FIELDS = {
    "text": ["text", "full_text", "content", "postText", "caption", "description"],
    "url": ["url", "postUrl", "link", "permalink", "twitterUrl"],
    "id": ["id", "postId", "tweetId", "urn"],
    "title": ["title", "headline"],
    "author": ["author.username", "author.userName", "author.name", "authorName", "username", "ownerUsername"],
    "score": ["likes", "likeCount", "likesCount", "score", "reactions"],
    "comments": ["comments", "replyCount", "commentsCount", "num_comments"],
    "timestamp": ["timestamp", "createdAt", "postedAt", "publishedAt", "date"],
}


def parsed(items: DataFrame, as_of: Column, fields: dict[str, list[str]] | None = None) -> DataFrame:
    """Posts of JSON ``items(value)``; what has neither text nor address goes.  ``fields`` overrides names."""
    names = FIELDS | (fields or {})
    get = lambda f: V.first_field(F.col("value"), names[f])
    rows = items.select(*[get(f).alias(f) for f in names]).where("coalesce(text, '') <> '' or coalesce(url, '') <> ''")
    return rows.select(
        F.coalesce("id", V.item_id(F.col("url"), F.col("text"))).alias("signal_id"),
        V.item_title(F.col("title"), F.col("text"), F.col("url")).alias("title"),
        "text",
        "url",
        "author",
        V.safe_int(F.col("score")).alias("score"),
        V.safe_int(F.col("comments")).alias("comment_count"),
        V.parsed_date(F.col("timestamp"), as_of).alias("timestamp"),
    )
