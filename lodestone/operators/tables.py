"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local one is made only where it is unset and all runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and survives the loss of an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; only for those that nothing will read again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(left: DataFrame, right: DataFrame, key: str, size: str, rows: int, share: int = 1000) -> DataFrame:
    """Inner join with a table of one row for each key, whose column ``size`` says how many rows of ``left`` have the key.

    Keys with at least one in ``share`` of the ``rows`` of ``left`` are joined by broadcast, where their rows lie: there are
    ``share`` of them at most (or fewer than that many rows). Only the others are shuffled, so no task gets a large group.
    """
    least = max(1, rows // share)
    large = F.broadcast(right.where(F.col(size) >= least))
    rest = left.join(large.select(key), key, "left_anti").join(right.where(F.col(size) < least), key)
    return left.join(large, key).unionByName(rest)


def key_difference(a: DataFrame, b: DataFrame, key: str, task_rows: int = 1 << 20) -> DataFrame:
    """(key, error): each row of ``a`` whose key ``b`` has not is missing, each key of ``b`` that ``a`` has not is unexpected, once.

    A null key equals none. Both tables are dealt by key to tasks of about ``task_rows`` rows, which only add up, however well the
    keys compress; nothing is sorted.
    """
    tasks = max(1, -(-(a.count() + b.count()) // task_rows))
    side = lambda df, is_a: df.select(key, F.lit(is_a).alias("n_a"), F.lit(not is_a).alias("in_b"))
    each = side(a, 1).unionByName(side(b, 0)).repartition(tasks, key).groupBy(key).agg(F.sum("n_a").cast("int").alias("n_a"), F.max("in_b").alias("in_b"))
    alone = F.col(key).isNull()
    missing = F.array_repeat(F.lit("missing"), F.when(alone | ~F.col("in_b"), F.col("n_a")).otherwise(0))
    unexpected = F.array_repeat(F.lit("unexpected"), F.when(F.col("in_b") & (alone | (F.col("n_a") == 0)), 1).otherwise(0))
    return each.select(key, F.explode(F.concat(missing, unexpected)).alias("error"))
