"""Live run states with timers: a run that falls silent fails, and no state outlives its run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import TERMINAL, TRANSITIONS

#: The state store that timers and times to live need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Lifecycle(StatefulProcessor):
    """One status and one event id for each run, and one timer."""

    def __init__(self, stale_ms: int):
        self.stale_ms = stale_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "status string, id bigint", ttlDurationMs=4 * self.stale_ms)

    def _timed(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.stale_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, last = self.run.get() if self.run.exists() else ("pending", -1)
        before = (status, last)
        seen = ((int(i), s) for df in rows for s, i in zip(df["status"], df["id"]) if s is not None)
        for i, s in sorted(seen):
            if i > last and s in TRANSITIONS.get(status, ()):
                status, last = s, i
        if (status, last) != before:
            self.run.update((status, last))
            yield pd.DataFrame({"run_id": [key[0]], "status": [status], "id": [last], "stale": [False]})
        if status not in TERMINAL or (status, last) != before:
            self._timed(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.run.exists():
            status, last = self.run.get()
            self.run.clear()
            if status == "running":
                yield pd.DataFrame({"run_id": [key[0]], "status": ["failed"], "id": [last], "stale": [True]})

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> SparkSession:
    """The session with the state store that ``live_runs`` needs; set before the stream starts."""
    spark.conf.set(*STORE)
    return spark


def live_runs(events: DataFrame, stale_minutes: float = 60) -> DataFrame:
    """``(run_id, status, id, stale)``: a row for each change of a run's status, for streams in update mode.

    Changes that aren't allowed are left out, and so are events with an id up to the last one.  A running run without an event
    for ``stale_minutes`` of processing time fails, with ``stale`` true.  Its state goes then; a finished run's state goes as long after
    its end, so that late events can't open it again before.  Null ids of runs are one run; null statuses change nothing.
    """
    kind = events.schema["run_id"].dataType.simpleString()
    rows = events.select("run_id", "status", "id").where("id is not null")
    return rows.groupBy("run_id").transformWithStateInPandas(Lifecycle(int(stale_minutes * 60_000)), f"run_id {kind}, status string, id bigint, stale boolean", "Update", "ProcessingTime")
