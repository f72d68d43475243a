"""Where queries are registered by name, each with its SQL twin if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) under a name."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rate(n: str, d: str, empty: str = "0.0") -> str:
    """SQL text of n / d to six places, halves to even."""
    return f"CASE WHEN ({d}) = 0 THEN {empty} ELSE round_even(({n}) / ({d}), 6) END"
