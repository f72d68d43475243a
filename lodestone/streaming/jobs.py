"""Streams of events: windowed counts, latest states, state machines, agreement, de-duplication, upserts and rates.

Every job runs until its input is read (``availableNow``), keeps its state and progress in a folder, and writes each micro-batch
under its number, so a batch that is repeated after a failure does not double. With a ``folder`` of its own in the shared folder a
job that is started again goes on where it stopped; otherwise it has a new one. Results are read back with the last batch
of each key.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from lodestone.operators.folds import fold
from lodestone.operators.tables import shared_dir
from lodestone.operators.review import upsert, vote_status

#: States of a job, and what an event makes of each of them; others leave it as it is.
TRANSITIONS = {
    ("queued", "click"): "running", ("running", "view"): "paused", ("paused", "click"): "running", ("running", "purchase"): "completed",
    ("running", "error"): "failed", ("queued", "error"): "cancelled", ("paused", "error"): "cancelled",
}


def events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over an event table, one file or a folder of them; times are instants of the session's zone."""
    # A pattern, as the source takes a plain path for a folder.
    files = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def batches(stream: DataFrame, mode: str = "update", folder: str | None = None) -> DataFrame:
    """Run a stream to the end of its input; all rows of all micro-batches, with their number as ``batch``."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{folder or uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/out/batch=-1")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{base}/out").schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/out")


def run(stream: DataFrame, keys: list[str], mode: str = "update", folder: str | None = None) -> DataFrame:
    """Run a stream to the end of its input; the last row of each key (all rows if there are no keys)."""
    out = batches(stream, mode, folder)
    if not keys:
        return out.drop("batch")
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return last.select("r.*")


def window_counts(stream: DataFrame, length: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling windows."""
    by = stream.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run(by.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n"), ["window_start", "event_type"])


def throughput(stream: DataFrame, length: str = "1 hour", slide: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Events of sliding windows, and how many thousandths of an event a second that is."""
    by = stream.withWatermark("ts", delay).groupBy(F.window("ts", length, slide).alias("w")).agg(F.count("*").alias("n"))
    made = by.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", F.floor(F.col("n") * 1000 / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("milli_per_second"))
    return run(made, ["window_start"])


def latest_states(stream: DataFrame) -> DataFrame:
    """The last event of each user."""
    by = stream.groupBy("user_id").agg(F.max(F.struct("event_id", "event_type", "value")).alias("last"), F.count("*").alias("n"))
    return run(by.select("user_id", "last.event_id", "last.event_type", "last.value", "n"), ["user_id"])


def agreement(stream: DataFrame) -> DataFrame:
    """Two-person agreement as votes arrive: the stream keeps each reviewer's last vote, the status follows from these."""
    by = stream.groupBy("sample_id", "reviewer").agg(F.max(F.struct("seq", "decision", "canonical_key")).alias("v"))
    return vote_status(run(by.select("sample_id", "reviewer", "v.*"), ["sample_id", "reviewer"]))


def first_of_content(stream: DataFrame, key: str, delay: str = "1 day") -> DataFrame:
    """The rows that bring a content for the first time within the delay."""
    return run(stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]), [], mode="append")


def upserts(stream: DataFrame, key: str, order: str, keep: tuple[str, ...], start: DataFrame, folder: str | None = None) -> DataFrame:
    """A table after the rows of a stream have replaced its rows by key, in the order of micro-batch and ``order``.

    Columns ``keep`` stay those of the table's row, or of the first row of a new key. Each micro-batch writes only what it
    brings; the table follows from its start and the first and last row of each key, so no version of it is rewritten.
    """
    rows = F.struct(*start.columns)
    at = F.struct("batch", order)
    by = batches(stream, "append", folder).groupBy(key).agg(F.min_by(rows, at).alias("first"), F.max_by(rows, at).alias("last"))
    last = by.select(*[F.col(f"{'first' if c in keep else 'last'}.{c}").alias(c) for c in start.columns])
    return upsert(start, last, key, keep)


def step(state: str, events_: list[str]) -> tuple[str, int]:
    """(state after the events, transitions made)."""
    n = 0
    for e in events_:
        after = TRANSITIONS.get((state, e), state)
        n += after != state
        state = after
    return state, n


def job_machine(stream: DataFrame) -> DataFrame:
    """State of each user's job after its events, in order of arrival number, kept between micro-batches."""

    def change(key, parts, state):
        status, made = state.get if state.exists else ("queued", 0)
        rows = pd.concat(list(parts)).sort_values("event_id")
        status, n = step(status, rows["event_type"].tolist())
        state.update((status, made + n))
        yield pd.DataFrame({"user_id": [key[0]], "status": [status], "transitions": [made + n]})

    schema = "user_id long, status string, transitions long"
    made = stream.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(change, schema, "status string, transitions long", "update", GroupStateTimeout.NoTimeout)
    return run(made, ["user_id"])


class _Job:
    """State of a job and how often it has changed."""

    def __init__(self, user):
        self.user, self.status, self.made = user, "queued", 0

    def take(self, event_id, event_type):
        self.status, n = step(self.status, [event_type])
        self.made += n
        return ()

    def end(self):
        return ((self.user, self.status, self.made),)


def job_machine_batch(rows: DataFrame) -> DataFrame:
    """The batch twin of ``job_machine``."""
    return fold(rows.select("user_id", "event_id", "event_type"), "user_id", ["event_id"], _Job, "user_id long, status string, transitions long")


def kept_in_time(rows: DataFrame, order: str, parts: int, length: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of tumbling windows if rows arrive in ``parts`` files by ``order``: those later than the watermark are dropped.

    The files are written one after another to the shared folder, and the stream reads one in each micro-batch.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    size = rows.agg(F.greatest(F.lit(1), F.ceil((F.max(order) + 1) / parts))).first()[0] or 1
    for k in range(parts):
        rows.where(F.floor(F.col(order) / size) == k).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    by = stream.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w")).agg(F.count("*").alias("n"))
    return run(by.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n"), ["window_start"])


def late(rows: DataFrame, order: str, delay_seconds: int, batches: int) -> DataFrame:
    """How many events come after the watermark if rows arrive in the order of ``order``, in equal batches: the batch oracle of late data."""
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    size = rows.agg(F.greatest(F.lit(1), F.ceil((F.max(order) + 1) / batches)).alias("size"))  # one row
    own = rows.crossJoin(F.broadcast(size)).withColumn("batch", F.floor(F.col(order) / F.col("size")))
    top = own.groupBy("batch").agg(F.max("ts").alias("top"))
    prior = top.select((F.col("batch") + 1).alias("batch"), "top")
    marks = own.select("batch").distinct().alias("b").join(prior.alias("p"), F.col("p.batch") <= F.col("b.batch"), "left").groupBy(F.col("b.batch").alias("batch")).agg(F.max("p.top").alias("seen"))
    return own.join(F.broadcast(marks), "batch").groupBy("batch").agg(F.count("*").alias("n"), F.count(F.when(F.unix_micros("ts") < F.unix_micros("seen") - delay_seconds * 1_000_000, 1)).alias("n_late"))
