"""The append-only event stream: cursor reads, live states, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STEP_EVENTS

#: Allowed changes of a run's status.
TRANSITIONS = {"pending": {"running", "canceled"}, "running": {"completed", "failed", "canceling"}, "canceling": {"canceled"}}
TERMINAL = {"completed", "failed", "canceled"}


def stream(spark: SparkSession, folder: str, schema: str = STEP_EVENTS, files: int | None = None) -> DataFrame:
    """Events from an append-only folder.  Delivery follows file offsets in the checkpoint, order follows event ids."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def after(events: DataFrame, run_id, cursor: int, n: int | None = None) -> DataFrame:
    """A batch cursor read: the run's events past an id, in order."""
    rows = events.where((F.col("run_id") == run_id) & (F.col("id") > cursor)).orderBy("id")
    return rows.limit(n) if n else rows


def appended(rows: DataFrame, folder: str) -> None:
    """Appends events; run and step ids mustn't be empty."""
    if not rows.where("coalesce(run_id, '') = '' or coalesce(step_id, '') = ''").isEmpty():
        raise ValueError("run_id and step_id are required")
    rows.write.mode("append").parquet(folder)


def copied(events: DataFrame, to: str, checkpoint: str, each: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """Everything there is now, once: micro-batches into ``to``, a batch's folder named by its number so that a repeat replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{to}/batch={number}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def states(events: DataFrame) -> DataFrame:
    """``(run_id, status, id)``: each run's latest status, for streams in update mode; changes that aren't allowed are left out.

    State is one status and one id for each run, whatever its number of events.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, last = state.get if state.exists else ("pending", -1)
        rows = pd.concat(list(frames)).sort_values("id")
        for s, i in zip(rows["status"], rows["id"]):
            if i > last and s in TRANSITIONS.get(status, ()):
                status, last = s, int(i)
        state.update((status, last))
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "id": [last]})

    kind = events.schema["run_id"].dataType.simpleString()
    return events.groupBy("run_id").applyInPandasWithState(step, f"run_id {kind}, status string, id bigint", "status string, id bigint", "update", "NoTimeout")


def counts_by_window(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event time, in windows that start every ``slide`` (else side by side); works for tables and, with late data up to
    ``late``, for streams."""
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    return rows.groupBy(F.window("created_at", window, slide), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(run_id, start, end, n)`` of each run's stretches of events without a pause of more than ``gap``; ``end`` is the last event's time
    and the gap.  For tables and, with late data up to ``late``, for streams in append mode."""
    rows = events.withWatermark("created_at", late) if events.isStreaming else events
    found = rows.groupBy("run_id", F.session_window("created_at", gap)).agg(F.count("*").alias("n"))
    return found.select("run_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def followed(first: DataFrame, then: DataFrame, within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """``(run_id, id, then_id)``: events of ``then`` in the same run after one of ``first``, up to ``within`` later.

    Of two streams the join keeps only the rows that watermarks and the bound on time still need.
    """
    a = first.select("run_id", "id", F.col("created_at").alias("_from"))
    b = then.select(F.col("run_id").alias("_run"), F.col("id").alias("then_id"), F.col("created_at").alias("_at"))
    a = a.withWatermark("_from", late) if first.isStreaming else a
    b = b.withWatermark("_at", late) if then.isStreaming else b
    return a.join(b, F.expr(f"run_id = _run and _at > _from and _at <= _from + interval {within}")).select("run_id", "id", "then_id")
