"""Jobs followed through their events: states with timers for jobs that show no sign of life, and estimates of the time they still need."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.streaming.jobs import run

#: States that a job can leave, with what an event makes of them; other events are signs of life only.
STEPS = {
    ("queued", "click"): "running", ("running", "view"): "paused", ("paused", "click"): "running", ("running", "purchase"): "completed",
    ("queued", "error"): "cancelling", ("running", "error"): "cancelling", ("paused", "error"): "cancelling", ("cancelling", "purchase"): "cancelled",
}
#: What becomes of a job whose process has gone; other states are final.
GONE = {"queued": "failed", "running": "failed", "paused": "failed", "cancelling": "cancelled"}

ROW = "user_id long, status string, transitions long, reconciled boolean, seen_ms long"


def moved(status: str, made: int, seen: int, events: list[tuple[int, str]], timeout_ms: int) -> tuple[str, int, bool, int]:
    """(status, transitions, whether it was reconciled, last sign of life) after events in order of time.

    A job that has been silent for ``timeout_ms`` is given up before the event that comes after the silence.
    """
    gone = False
    for at, event in events:
        if status in GONE and at - seen >= timeout_ms:
            status, made, gone = GONE[status], made + 1, True
        after = STEPS.get((status, event), status)
        made += after != status
        status, seen = after, max(seen, at)
    return status, made, gone, seen


class JobTracker(StatefulProcessor):
    """State of one job: kept as a value, with one timer at the end of its silence; a job in a final state keeps none."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, transitions long, reconciled boolean, seen_ms long")

    def _row(self, key, status, made, gone, seen) -> pd.DataFrame:
        self.job.update((status, made, gone, seen))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if status in GONE:
            self.handle.registerTimer(seen + self.timeout_ms)
        return pd.DataFrame({"user_id": [key[0]], "status": [status], "transitions": [made], "reconciled": [gone], "seen_ms": [seen]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own = pd.concat([r[["at_ms", "event_id", "event_type"]] for r in rows]).sort_values(["at_ms", "event_id"])
        events = list(zip(own["at_ms"].tolist(), own["event_type"].tolist(), strict=True))
        status, made, gone, seen = self.job.get() if self.job.exists() else ("queued", 0, False, events[0][0])
        status, made, now_gone, seen = moved(status, made, seen, events, self.timeout_ms)
        yield self._row(key, status, made, gone or now_gone, seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, made, gone, seen = self.job.get()
        if status in GONE:
            yield self._row(key, GONE[status], made + 1, True, seen)

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark):
    """State with variables and timers needs the RocksDB store; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tracked_jobs(stream: DataFrame, timeout_seconds: int, delay: str, folder: str | None = None) -> DataFrame:
    """State of each user's job after its events and its silences: (user_id, status, transitions, reconciled, seen_ms).

    A job is driven by ``STEPS``. One that is not in a final state and silent for ``timeout_seconds`` of event time is reconciled: it
    was being cancelled and is cancelled, or it failed. Silence shows when a later event of the job comes, or when the watermark,
    ``delay`` behind the newest event of all jobs, passes the job's timer. Events later than the watermark are dropped.

    The state of a job is one row; its events of one micro-batch are sorted in its task.
    """
    rows = stream.withWatermark("ts", delay).select("user_id", "event_id", "event_type", "ts", F.unix_millis("ts").alias("at_ms"))
    made = rows.groupBy("user_id").transformWithStateInPandas(JobTracker(timeout_seconds * 1000), ROW, "Update", "EventTime")
    with _rocks(stream.sparkSession):
        return run(made, ["user_id"], folder=folder)


def progress(stream: DataFrame, totals: DataFrame, length: str, slide: str, delay: str, folder: str | None = None) -> DataFrame:
    """Progress of jobs at the end of each ``slide`` in which they had one: (user_id, window_end, done, total, remaining_seconds).

    The stream counts a job's events by ``slide``, in append mode, so a count is final when the watermark has passed it, and joins
    the job's total, which is a table (user_id, total). Over what the stream wrote, the rate of a job is that of the last
    ``length``; ``remaining_seconds`` is what is left at this rate, 0 when nothing is. A job without a total has no row.
    """
    counts = stream.withWatermark("ts", delay).groupBy("user_id", F.window("ts", slide).alias("w")).agg(F.count("*").alias("n"))
    ended = counts.select("user_id", F.unix_seconds("w.end").alias("end"), "n").join(totals, "user_id")
    written = run(ended, [], mode="append", folder=folder)
    seconds = F.expr(f"cast(interval '{length}' as interval second)").cast("decimal(18,0)").cast("long")
    width = int(stream.sparkSession.range(1).select(seconds).first()[0])
    by = Window.partitionBy("user_id").orderBy("end")
    seen = written.withColumns({"done": F.sum("n").over(by), "lately": F.sum("n").over(by.rangeBetween(-width + 1, 0))})
    left = F.greatest(F.lit(0), F.col("total") - F.col("done"))
    return seen.select("user_id", F.timestamp_seconds("end").cast("timestamp_ntz").alias("window_end"), "done", "total", F.floor(left * width / F.col("lately")).alias("remaining_seconds"))
