"""Column builders that several operators share. All are built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_if(condition: Column) -> Column:
    """How many rows meet a condition, as a long; 0 for no rows."""
    return F.count(F.when(condition, 1))


def rate0(n: Column, d: Column) -> Column:
    """n / d to six places, halves to even; 0.0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.bround(n / F.when(d != 0, d), 6))


def rate_null(n: Column, d: Column) -> Column:
    """n / d to six places, halves to even; null where d is 0."""
    return F.bround(n / F.when(d != 0, d), 6)


def filled(*columns: Column) -> Column:
    """The first of some text columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def token_true(c: Column) -> Column:
    """Whether a text is one of 1, true, yes, on."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def blank_metadata(c: Column) -> Column:
    """Whether a metadata text says nothing."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("", "none", "unknown", "unspecified", "n/a", "na")


def codes(*pairs: tuple[str, Column]) -> Column:
    """Array of the codes whose conditions hold, in the given order."""
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in pairs]), lambda x: x.isNotNull())


def ladder(default, *steps: tuple[Column, object]) -> Column:
    """The value of the first condition that holds."""
    made = reduce(lambda w, s: w.when(*s) if w is not None else F.when(*s), steps, None)
    return made.otherwise(default)


def contains_any(c: Column, markers: tuple[str, ...]) -> Column:
    """Whether a text has one of the markers."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(m)) for m in markers])


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(F.lit(0), x2 - x1) * F.greatest(F.lit(0), y2 - y1)


def overlap(a: str, b: str) -> Column:
    """Area that the boxes with column prefixes ``a`` and ``b`` share."""
    c = F.col
    return area(F.greatest(c(f"{a}x1"), c(f"{b}x1")), F.greatest(c(f"{a}y1"), c(f"{b}y1")), F.least(c(f"{a}x2"), c(f"{b}x2")), F.least(c(f"{a}y2"), c(f"{b}y2")))


def box_area(a: str) -> Column:
    return area(*[F.col(f"{a}{k}") for k in ("x1", "y1", "x2", "y2")])


def tanimoto(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two sets, to six places; null where both are empty or one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull() & (union > 0), F.bround(F.size(F.array_intersect(a, b)) / union, 6))
