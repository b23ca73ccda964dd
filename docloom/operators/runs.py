"""Workflow runs: listing, correlation with steps and events, summaries, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The stored statuses behind those that are shown.
SHOWN = {"PENDING": ["pending", "running", "canceling"], "SUCCESS": ["completed"], "WARNING": ["completed_with_errors"], "ERROR": ["failed"], "CANCELLED": ["canceled"], "ENQUEUED": ["pending"]}


def listed(runs: DataFrame, status: str | None = None, search: str | None = None, kind: str | None = None, parent: str | None = None, n: int = 50, offset: int = 0) -> DataFrame:
    """A page of runs, newest first.  Kind and parent are looked up in the metadata after the page is cut, so pages may be short."""
    if status:
        runs = runs.where(F.col("status").isin(SHOWN.get(status.upper(), [status.lower()])))
    if search:
        runs = runs.where(F.col("id").like(f"%{search}%") | F.col("workflow").like(f"%{search}%"))
    rows = runs.orderBy(F.col("started_at").desc_nulls_last(), "id").offset(offset).limit(n)
    own_parent = F.get_json_object("metadata_json", "$.parent_workflow_id")
    rows = rows.where(own_parent == parent if parent else own_parent.isNull())
    return rows.where(F.get_json_object("metadata_json", "$.workflow_type") == kind) if kind else rows


def by_prefix(runs: DataFrame, text: str) -> DataFrame:
    """The run of this id, else the first whose id starts with it."""
    return runs.where(F.col("id").startswith(text)).orderBy((F.col("id") != text), "id").limit(1)


def correlated(runs: DataFrame, steps: DataFrame, events: DataFrame, n: int = 20) -> DataFrame:
    """Each run with its steps and its last ``n`` events as nested rows."""
    own = steps.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "status", "output_count", "error_count"))).alias("steps"))
    from .analytics import latest_events

    last = latest_events(events, n).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("id", "status"))).alias("events"))
    return runs.join(own, runs["id"] == own["run_id"], "left").drop("run_id").join(last, runs["id"] == last["run_id"], "left").drop("run_id")


def outputs(steps: DataFrame) -> DataFrame:
    """Sums over a run's steps; zero sums are null."""
    zero = lambda c: F.nullif(F.coalesce(F.sum(c), F.lit(0)), F.lit(0).cast("bigint"))
    success = F.greatest(F.lit(0), F.coalesce("output_count", F.lit(0)) - F.coalesce("error_count", F.lit(0)))
    return steps.groupBy("run_id").agg(zero("output_count").alias("total_output"), zero(success).alias("total_success"), zero("error_count").alias("total_errors"))


def merged_metadata(old: Column, new: Column) -> Column:
    """Two flat JSON objects of texts as one; new keys win."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    kept = F.map_filter(parsed(old), lambda k, v: ~F.coalesce(F.map_contains_key(parsed(new), k), F.lit(False)))
    return F.to_json(F.map_concat(kept, parsed(new)))
