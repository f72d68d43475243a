"""Helpers that the training-data operators share: intermediate tables, column names that can't clash, sizes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.tables import discard, join_counted, materialise, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Spark hand texts to Python in batches of at most so many rows.

    Texts run from nothing to hundreds of kilobytes, and a worker holds a batch several times over; Spark's usual 10,000 rows
    suit numbers. A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


_kept: dict = {}


def resident(name: str, make):
    """What a worker process keeps between tasks under ``name``, such as a tokenizer and its cache; made where it is missing.

    Worker processes live on through all stages, so only one operator's is kept: that of another operator goes first.
    """
    if name not in _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()
        _kept[name] = make()
    return _kept[name]


def fresh(df: DataFrame, name: str, *others: DataFrame) -> str:
    """``name``, or a longer name where a column of these DataFrames already has it (compared without case)."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole(column: str):
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
