"""The document registry: discovery rows left-joined with fetch rows, filtered and shown as one lifecycle view."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.url import matches_any

M, X = "m", "x"


@dataclass
class Filters:
    """What a listing asks for; None, empty and zero values ask nothing, except ``False`` where a boolean is meant."""

    ids: list[str] = field(default_factory=list)
    url_contains: str | None = None
    map_status: str | None = None
    fetch_status: str | None = None
    source_type: str | None = None
    discovery_method: str | None = None
    discovery_url: str | None = None
    fetch_engine: str | None = None
    has_content: bool | None = None
    min_content_length: int | None = None
    not_fetched: bool = False
    has_error: bool | None = None
    user_id: str | None = None
    workspace_id: str | None = None
    created_after: datetime | None = None
    created_before: datetime | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    urls: list[str] = field(default_factory=list)
    file_ext: str | None = None
    order_by: str | None = None
    descending: bool = False
    limit: int | None = None
    offset: int | None = None


def joined(map_documents: DataFrame, fetch_documents: DataFrame) -> DataFrame:
    return map_documents.alias(M).join(fetch_documents.alias(X), F.col("m.document_id") == F.col("x.document_id"), "left")


def globs(f: Filters) -> Column:
    """The shell globs on addresses, matched whole."""
    found = matches_any(F.col("m.source_url"), f.include) if f.include else F.lit(True)
    return found & ~matches_any(F.col("m.source_url"), f.exclude) if f.exclude else found


def predicate(f: Filters) -> Column:
    """All row predicates but the globs."""
    c = F.col
    tests = []
    if f.ids:
        tests.append(c("m.document_id").isin(f.ids))
    if f.url_contains:  # a LIKE: % and _ keep their meaning
        tests.append(c("m.source_url").like(f.url_contains.replace("*", "%") if "*" in f.url_contains else f"%{f.url_contains}%"))
    for column, value in (("m.status", f.map_status), ("x.status", f.fetch_status), ("m.source_type", f.source_type), ("m.discovery_method", f.discovery_method), ("m.discovery_url", f.discovery_url), ("x.fetch_engine", f.fetch_engine), ("m.user_id", f.user_id), ("m.workspace_id", f.workspace_id)):
        if value:
            tests.append(c(column) == value)
    if f.has_content is not None:
        tests.append(c("x.content_length") > 0 if f.has_content else (c("x.content_length") == 0) | c("x.content_length").isNull())
    if f.min_content_length:
        tests.append(c("x.content_length") >= f.min_content_length)
    if f.not_fetched:
        tests.append(c("x.document_id").isNull() | (c("x.status") == "PENDING"))
    if f.has_error is not None:
        some = c("m.error").isNotNull() | c("x.error").isNotNull()
        tests.append(some if f.has_error else ~some)
    if f.created_after:
        tests.append(c("m.created_at") >= F.lit(f.created_after))
    if f.created_before:
        tests.append(c("m.created_at") <= F.lit(f.created_before))
    if f.urls:
        tests.append(c("m.source_url").isin(f.urls))
    if f.file_ext:
        tests.append(c("m.source_url").endswith("." + f.file_ext.lstrip(".")))
    found = F.lit(True)
    for t in tests:
        found = found & t
    return found


def stage() -> Column:
    status = F.col("x.status")
    return F.when(status == "SUCCESS", "fetched").when(status == "PENDING", "fetching").when(F.col("m.status").isNotNull(), "mapped").otherwise("unknown")


def listing(map_documents: DataFrame, fetch_documents: DataFrame, f: Filters | None = None) -> DataFrame:
    """The view's rows.  Limits come after all filters, globs included; an offset before globs if there are globs.

    Sorting by an unknown field asks nothing; equal values are ordered by id.
    """
    f = f or Filters()
    rows = joined(map_documents, fetch_documents).where(predicate(f))
    order = {"created_at": F.col("m.created_at"), "source_url": F.col("m.source_url"), "content_length": F.col("x.content_length")}.get(f.order_by or "")
    if order is not None:
        rows = rows.orderBy(order.desc_nulls_last() if f.descending else order.asc_nulls_first(), F.col("m.document_id"))
    if f.offset:
        rows = rows.offset(f.offset)
    rows = rows.where(globs(f))
    if f.limit:
        rows = rows.limit(f.limit)
    fetchable = (F.col("m.status") == "SUCCESS") & (F.col("x.status").isNull() | F.col("x.status").isin("PENDING", "ERROR"))
    return rows.select(
        F.col("m.document_id").alias("document_id"),
        F.col("m.source_url").alias("source_url"),
        F.col("m.source_type").alias("source_type"),
        F.col("m.discovery_method").alias("discovery_method"),
        F.col("m.title").alias("title"),
        F.col("m.status").alias("map_status"),
        F.col("x.status").alias("fetch_status"),
        F.col("x.content_length").alias("content_length"),
        F.col("x.fetch_engine").alias("fetch_engine"),
        F.coalesce(F.nullif(F.col("x.error"), F.lit("")), F.col("m.error")).alias("error"),
        stage().alias("current_stage"),
        ((F.col("m.status") == "ERROR") | F.coalesce(F.col("x.status") == "ERROR", F.lit(False))).alias("has_error"),
        fetchable.alias("is_fetchable"),
        F.coalesce(F.col("x.status") == "SUCCESS", F.lit(False)).alias("is_fetched"),
    )


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def with_newness(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``is_new``: whether the id is in no row of ``known``."""
    ids = known.select("document_id").distinct().withColumn("_known", F.lit(True))
    return rows.join(ids, "document_id", "left").withColumn("is_new", F.col("_known").isNull()).drop("_known")


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("document_id").distinct(), "document_id", "left_anti")
