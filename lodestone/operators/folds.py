"""Folds whose steps depend on earlier ones, over rows that Spark has dealt by key and sorted.

A task reads its keys one after another as a stream: it keeps the state of one key, never its rows, and no key costs a call
of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold(Protocol):
    """State of one key."""

    def take(self, *row) -> Iterable[tuple]:
        """The rows that come out after a row (its columns without the key)."""

    def end(self) -> Iterable[tuple]:
        """The rows that come out when the key has no more."""


def values(column: pa.Array) -> list:
    """The values of a column as ``to_pylist`` gives them, by way of numpy for common kinds, which is some ten times as fast."""
    kind, nulls = column.type, column.null_count
    if nulls == len(column):
        return [None] * nulls
    if pa.types.is_integer(kind) and nulls:
        return column.to_pandas(integer_object_nulls=True).tolist()
    if pa.types.is_string(kind) or pa.types.is_boolean(kind) or pa.types.is_integer(kind) or (pa.types.is_floating(kind) and not nulls):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def fold(rows: DataFrame, key: str, order: list[str | Column], start: Callable[[object], Fold], schema: str | StructType, rows_out: int = 4096) -> DataFrame:
    """Fold the rows of each ``key`` (the first column) in the order of ``order``; ``start`` makes the state of a key."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches):
        state, at, out = None, None, []
        for part in batches:
            for own, *row in zip(*map(values, part.columns), strict=True):
                if state is None or own != at:
                    if state is not None:
                        out += state.end()
                    state, at = start(own), own
                out += state.take(*row)
            if len(out) >= rows_out:
                yield batch(out)
                out = []
        if state is not None:
            out += state.end()
        yield batch(out)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
