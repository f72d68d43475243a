"""Places in an order, without one long sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import materialise


def numbered(rows: DataFrame, group: str, *order: str, name: str = "place") -> DataFrame:
    """Rows with their place (from 0) in the order of their group.

    Rows are dealt by ranges of (group, order) and numbered within their task; what earlier tasks hold of the group is added
    from one count for each task and group. A group may have any share of the rows.
    """
    keys = [group, *order]
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    own = materialise(dealt.withColumns({"task_": F.shiftright(at, 33), "at_": at.bitwiseAND((1 << 33) - 1)}), "ordered")
    runs = own.groupBy(group, "task_").agg(F.min("at_").alias("first_"), F.count("*").alias("n_"))
    earlier = Window.partitionBy(group).orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    base = runs.select(F.col(group).alias("group_"), F.col("task_").alias("of_"), (F.coalesce(F.sum("n_").over(earlier), F.lit(0)) - F.col("first_")).alias("base_"))
    joined = own.join(base, own[group].eqNullSafe(base["group_"]) & (own["task_"] == base["of_"]))
    return joined.select(*rows.columns, (F.col("at_") + F.col("base_")).alias(name))


def order_statistic(rows: DataFrame, value: str, place: int, bins: int = 1024) -> tuple[float, float | None]:
    """The value at a place (from 0) in the order of a numeric column without nulls, and the next greater value or equal one after it.

    Exact, by rounds of histograms: values are counted in ``bins`` equal ranges, and the one that holds the place is cut again
    from its least to its greatest value, until these are equal. A round moves a row for each range and task.
    """
    own = rows.select(F.col(value).cast("double").alias("v"))
    low, high = own.agg(F.min("v"), F.max("v")).first()
    before, n = 0, None
    while low < high:
        at = F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / (high - low) * bins))
        cells = own.where(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect()  # at most ``bins``
        for c in cells:
            if place < before + c["n"]:
                low, high, n = c["low"], c["high"], c["n"]
                break
            before += c["n"]
    after = low if n is None or place + 1 < before + n else own.where(F.col("v") > low).agg(F.min("v")).first()[0]
    return low, after


def exact_percentile(rows: DataFrame, value: str, share: float) -> float | None:
    """The value that a share of the rows stays below, between two values in proportion; null for no rows. Nulls are left out."""
    known = rows.where(F.col(value).isNotNull())
    n = known.count()
    if not n:
        return None
    place = (n - 1) * share
    low, after = order_statistic(known, value, int(place))
    return low if after is None else (int(place) + 1 - place) * low + (place - int(place)) * after
