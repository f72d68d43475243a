"""Where users bring code of their own: predictors, named backends, scoring functions, detectors and rule profiles.

User code runs on Arrow batches in tasks; Spark deals the rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A function from batches of rows to batches of predictions.
Predictor = Callable[[pd.DataFrame], pd.DataFrame]


def predict(rows: DataFrame, predictor: Predictor, schema: str) -> DataFrame:
    """What ``predictor`` makes of the rows, batch by batch; a batch gives as many rows as it likes, in columns of ``schema``."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield predictor(part)[names]

    return rows.mapInPandas(run, schema)


class Backends:
    """Predictors by name, with one schema."""

    def __init__(self, schema: str):
        self.schema, self.known = schema, {}

    def add(self, name: str, predictor: Predictor) -> Backends:
        if name in self.known:
            raise ValueError(f"backend {name} is there already")
        self.known[name] = predictor
        return self

    def run(self, rows: DataFrame, *names: str) -> DataFrame:
        """Predictions of the named backends, or of all, with ``backend``."""
        unknown = set(names) - set(self.known)
        if unknown or not self.known:
            raise ValueError(f"unknown backends: {', '.join(sorted(unknown))}")
        made = None
        for name in names or tuple(self.known):
            own = predict(rows, self.known[name], self.schema).withColumn("backend", F.lit(name))
            made = own if made is None else made.unionByName(own)
        return made


def scored(rows: DataFrame, name: str, function: Callable[..., pd.Series], kind: str, *columns: str | Column) -> DataFrame:
    """``rows`` with what ``function`` makes of some columns, as a vectorised user function."""
    return rows.withColumn(name, F.pandas_udf(function, kind)(*columns))


def detector(schema: str, find: Callable[..., Iterator[tuple]]):
    """A table function that gives any number of regions for a page, for use in ``lateral`` joins."""

    class Regions:
        def eval(self, *page):
            yield from find(*page)

    return F.udtf(Regions, returnType=schema)


def profiles(spark: SparkSession, settings: dict[tuple[str, str], dict]) -> DataFrame:
    """(profile, version, settings, profile_sha256) of named rule profiles; the digest is of their settings as sorted JSON."""
    rows = []
    for (name, version), values in sorted(settings.items()):
        text = json.dumps(values, sort_keys=True, separators=(",", ":"))
        rows.append((name, version, {k: float(v) for k, v in values.items()}, hashlib.sha256(text.encode()).hexdigest()))
    return spark.createDataFrame(rows, "profile string, version string, settings map<string,double>, profile_sha256 string")


def with_profile(rows: DataFrame, known: DataFrame, name: str = "profile") -> DataFrame:
    """Rows with the settings and digest of the profile that they name; fails at run time where one names none.

    There are few profiles, so they are told to the rows by broadcast.
    """
    joined = rows.join(F.broadcast(known.withColumnRenamed("profile", name)), name, "left")
    missing = F.raise_error(F.concat(F.lit("unknown profile: "), F.coalesce(F.col(name), F.lit("null"))))
    return joined.withColumn("profile_sha256", F.coalesce("profile_sha256", missing.cast("string")))
