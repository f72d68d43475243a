"""Splits that keep linked rows together, leakage checks, and deterministic samples."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.graph import components
from lodestone.operators.order import numbered
from lodestone.operators.tables import materialise

LABELS = ("train", "validation", "test")


def linked_groups(rows: DataFrame, order: str, *keys: str, ignore: tuple[str, ...] = ("", "negative", "invalid")) -> DataFrame:
    """(order, component): rows that share a value of any key are one component, named by its smallest row.

    Rows link to the first row of each of their values, a star for each value, so a value with a third of all rows costs as
    many edges as it has rows. The keys are written once, as a narrow table: whatever they are computed from is read once.
    """
    edges, rows = None, materialise(rows.select(order, *keys), "keys")
    for k in keys:
        own = rows.where(F.col(k).isNotNull() & ~F.trim(F.col(k).cast("string")).isin(*ignore)).select(F.col(order).alias("a"), F.trim(F.col(k).cast("string")).alias("v"))
        star = own.join(own.groupBy("v").agg(F.min("a").alias("b")), "v").where("a <> b").select("a", "b")
        edges = star if edges is None else edges.unionByName(star)
    roots = components(edges)
    return rows.select(order).join(roots, rows[order] == roots.node, "left").select(order, F.coalesce("root", order).alias("component"))


def fill_plan(sizes: dict[int, int], shares: tuple[float, ...]) -> list[tuple[int, int, int, int]]:
    """Places for groups, the largest first, each in the split that is filled least: (size, from turn, to turn, split).

    Works on how many groups there are of each size. One by one, a group goes to the split with the least filled share of its target
    (of equal shares that with fewer rows, then the first); so of the groups of one size the splits take those steps that start at the
    lowest shares, as many as there are groups. Their numbers are those of filling one by one; a split's groups are a run of turns.
    """
    total = sum(s * n for s, n in sizes.items())
    target = [max(1.0, total * x / sum(shares)) for x in shares]
    filled, rows = [0] * len(shares), []
    for size in sorted(sizes, reverse=True):
        left = sizes[size]
        # Steps that start below a common share, which is found by halving; the last ones go one by one.
        take = lambda level: [max(0, math.ceil((level * t - f) / size) - 1) for t, f in zip(target, filled, strict=True)]  # noqa: B023, E731
        low, high = 0.0, max(f / t for f, t in zip(filled, target, strict=True)) + left * size / min(target) + 1
        for _ in range(80):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(take(middle)) <= left else (low, middle)
        counts = take(low)
        while sum(counts) > left - len(shares) and any(counts):  # leave a few, as shares are rounded
            counts[max(range(len(shares)), key=lambda i: (filled[i] + counts[i] * size) / target[i] if counts[i] else -1)] -= 1  # noqa: B023
        for _ in range(left - sum(counts)):
            k = min(range(len(shares)), key=lambda i: ((filled[i] + counts[i] * size) / target[i], filled[i] + counts[i] * size, i))  # noqa: B023
            counts[k] += 1
        turn = 0
        for k, n in enumerate(counts):
            if n:
                rows.append((size, turn, turn + n, k))
                turn += n
                filled[k] += n * size
    return rows


def grouped_split(groups: DataFrame, order: str, component: str = "component", shares: tuple[float, ...] = (0.8, 0.1, 0.1), labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(order, component, split): whole components, the largest first, to the split that is filled least.

    Only the number of components of each size reaches the driver (fewer numbers than twice the root of the rows); the turn
    of a component among those of its size is counted in two steps, within ranges and over ranges.
    """
    spark = groups.sparkSession
    sizes = groups.groupBy(component).agg(F.count("*").alias("size"))
    counts = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame([(s, a, b, labels[k]) for s, a, b, k in fill_plan(counts, shares)], "size long, low long, high long, split string")
    cell = F.pmod(F.xxhash64(component), F.lit(256))
    placed = sizes.withColumn("cell", cell)
    base = placed.groupBy("size", "cell").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = placed.withColumn("turn", F.row_number().over(Window.partitionBy("size", "cell").orderBy(component)) - 1).join(base.select("size", "cell", "base"), ["size", "cell"])
    at = turn.select(component, "size", (F.col("turn") + F.col("base")).alias("turn")).join(F.broadcast(plan), "size").where("turn >= low and turn < high")
    return groups.join(at.select(component, "split"), component).select(order, component, "split")


def split_plan(split: DataFrame, component: str = "component") -> DataFrame:
    """(size, split, n): how many components of each size a split got."""
    sizes = split.groupBy(component, "split").agg(F.count("*").alias("size"))
    return sizes.groupBy("size", "split").agg(F.count("*").alias("n"))


def leakage(rows: DataFrame, split: str, *keys: str, ignore: tuple[str, ...] = ("", "negative", "invalid", "acyclic")) -> DataFrame:
    """Values of the keys that occur in more than one split: (key, value, n_splits, n_rows)."""
    long = rows.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.trim(F.col(k).cast("string")).alias("value")) for k in keys])).alias("k")).select(split, "k.*")
    by = long.where(F.col("value").isNotNull() & ~F.col("value").isin(*ignore) & (F.col(split) != "")).groupBy("key", "value", split).agg(F.count("*").alias("n"))
    return by.groupBy("key", "value").agg(F.count("*").alias("n_splits"), F.sum("n").alias("n_rows")).where("n_splits > 1")


def group_checks(rows: DataFrame, group: str, split: str, identity: str) -> DataFrame:
    """Groups that are in several splits or have several identities."""
    found = rows.groupBy(group).agg(F.count_distinct(split).alias("n_splits"), F.count_distinct(identity).alias("n_identities"), F.count("*").alias("n"))
    return found.where("n_splits > 1 or n_identities > 1")


def holdout(rows: DataFrame, group: str, share: float = 0.2) -> DataFrame:
    """Whole groups into test, the largest first, until it has the share; the rest train. (group, n, part)"""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    # How many rows the groups of greater size have: from the sizes, of which there are few.
    by = sizes.groupBy("n").agg(F.count("*").alias("groups"))
    before = by.withColumn("above", F.coalesce(F.sum(F.col("n") * F.col("groups")).over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("n", "above")
    total = sizes.agg(F.greatest(F.lit(1), F.bround(F.sum("n") * share, 0).cast("long")).alias("target"))  # one row
    ranked = numbered(sizes.join(before, "n"), "n", group, name="turn")
    return ranked.crossJoin(F.broadcast(total)).select(group, "n", F.when(F.col("above") + F.col("turn") * F.col("n") < F.col("target"), "test").otherwise("train").alias("part"))


def _rounded_share(n: int, share: float) -> int:
    """The least whole number of rows that is at least ``share`` of ``n``, exactly for shares of up to nine places."""
    return -(-n * round(share * 10**9) // 10**9)


def class_quotas(counts: dict, n: int) -> dict:
    """``n`` rows shared out to classes by their counts: whole parts, then the largest remainders, of equal ones the first by name."""
    total = sum(counts.values())
    quota = {c: n * k // total for c, k in counts.items()}
    by_rest = sorted(counts, key=lambda c: (-(n * counts[c] % total), str(c)))
    for c in by_rest[: n - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_split(rows: DataFrame, key: str, label: str | None, share: float = 0.2, seed: str = "7") -> DataFrame:
    """(key, part): of each class its exact share of the test rows, those with the least hashes of seed and key; the rest train.

    Without ``label``, or where a class has one row only, all rows are one class. What reaches the driver is a number for each class.
    """
    classed = rows.select(key, (F.col(label) if label else F.lit(0)).alias("class_"), F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("hash_"))
    counts = {r["class_"]: r["n"] for r in classed.groupBy("class_").agg(F.count("*").alias("n")).collect()}
    if counts and min(counts.values()) < 2:
        classed, counts = classed.withColumn("class_", F.lit(0)), {0: sum(counts.values())}
    quotas = class_quotas(counts, _rounded_share(sum(counts.values()), share)) if counts else {}
    plan = rows.sparkSession.createDataFrame(list(quotas.items()), T.StructType([T.StructField("of_", classed.schema["class_"].dataType), T.StructField("quota_", T.LongType())]))
    turned = numbered(classed, "class_", "hash_", key)
    return turned.join(F.broadcast(plan), turned["class_"].eqNullSafe(plan["of_"])).select(key, F.when(F.col("place") < F.col("quota_"), "test").otherwise("train").alias("part"))


def holdout_split(rows: DataFrame, key: str, group: str, label: str | None = None, share: float = 0.2) -> DataFrame:
    """(key, part, reason): whole groups held out, or where that can't serve, an exact stratified split and the reason why.

    Without a train or test row the reason is ``random_fallback_single_scaffold``; with ``label``, where either part has fewer than
    two classes, ``random_fallback_class_coverage``; else ``scaffold``. One row of counts decides.
    """
    own = rows.select(key, group, *([label] if label else []))
    placed = own.join(holdout(own, group, share).select(group, "part"), group)
    by = {r["part"]: r["classes"] for r in placed.groupBy("part").agg((F.count_distinct(label) if label else F.lit(2)).alias("classes")).collect()}
    if len(by) < 2:
        reason = "random_fallback_single_scaffold"
    elif min(by.values()) < 2:
        reason = "random_fallback_class_coverage"
    else:
        reason = "scaffold"
    parts = placed.select(key, "part") if reason == "scaffold" else stratified_split(own, key, label, share)
    return parts.withColumn("reason", F.lit(reason))


def recheck_quotas(counts: dict[str, int], n: int, turn: list[str]) -> dict[str, int]:
    """How many of ``n`` rows each stratum gets: its share, at least one, at most all it has.

    Surplus over ``n`` is taken from where the share is exceeded most, what is missing goes to where it falls short most. With
    fewer rows than strata, the first ``n`` of ``turn`` get one each.
    """
    if n < len(counts):
        return {s: int(s in turn[:n]) for s in counts}
    total = sum(counts.values())
    quota = {s: min(k, max(1, n * k // total)) for s, k in counts.items()}
    short = lambda s: n * counts[s] - quota[s] * total
    while sum(quota.values()) > n:
        quota[min((s for s in quota if quota[s] > 1), key=lambda s: (short(s), s))] -= 1
    while sum(quota.values()) < n:
        quota[max((s for s in quota if quota[s] < counts[s]), key=lambda s: (short(s), counts[s], s))] += 1
    return quota


def recheck_sample(rows: DataFrame, existing: DataFrame, stratum: str, key: str, share: float, most: int | None = None, seed: str = "7") -> DataFrame:
    """(stratum, key, origin): a queue with ``share`` of the rows, to which rows that are in it already count.

    ``origin`` is ``existing``, ``quota`` (the rows that a stratum lacks, by least hashes of seed and key), or ``refill`` (where strata
    have run out, by least hashes over all strata). Existing keys that no row has are left out; a null stratum is the empty one.
    No row leaves the queue, so it may be larger than asked for. What reaches the driver is a number for each stratum.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    known = existing.select(key).distinct().withColumn("known_", F.lit(True))
    own = materialise(rows.select(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias(stratum), key, hashed.alias("hash_")).join(known, key, "left"), "recheck")
    found = own.groupBy(stratum).agg(F.count("*").alias("n"), F.count("known_").alias("known")).collect()
    counts, had = {r[stratum]: r["n"] for r in found}, {r[stratum]: r["known"] for r in found}
    total = sum(counts.values())
    n = round(total * share)
    n = min(max(n, 1) if share > 0 and total else n, total, total if most is None else most)
    turn = sorted(counts, key=lambda s: (hashlib.md5(f"{seed}:{s}".encode()).hexdigest(), s))
    lacking = {s: max(0, q - had[s]) for s, q in recheck_quotas(counts, n, turn).items()}
    plan = rows.sparkSession.createDataFrame([(s, k, counts[s] - had[s]) for s, k in lacking.items()], f"{stratum} string, lacking_ long, there_ long")
    spare = max(0, n - sum(had.values()) - sum(min(k, counts[s] - had[s]) for s, k in lacking.items()))
    new = numbered(own.where("known_ is null").select(stratum, key, "hash_"), stratum, "hash_", key).join(F.broadcast(plan), stratum)
    out = own.where("known_").select(stratum, key, F.lit("existing").alias("origin")).unionByName(new.where("place < lacking_").select(stratum, key, F.lit("quota").alias("origin")))
    if not spare:
        return out
    rest = new.where("place >= lacking_").orderBy("hash_", key).limit(spare)
    return out.unionByName(rest.select(stratum, key, F.lit("refill").alias("origin")))


def hash_sample(rows: DataFrame, key: str, n: int, train: int, seed: str = "7") -> DataFrame:
    """The ``n`` keys with the least hashes of seed and key, in that order; the first ``train`` of them train."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    top = rows.select(key).distinct().withColumn("order", order).orderBy("order").limit(n)
    return top.withColumn("turn", F.row_number().over(Window.orderBy("order"))).select(key, "turn", F.when(F.col("turn") <= train, "train").otherwise("dev").alias("part"))


def strata_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str = "7") -> DataFrame:
    """About ``n`` rows with each stratum's share, at least one each: largest remainders, then least hashes within a stratum."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    share = counts.crossJoin(F.broadcast(total)).withColumns({"base": F.greatest(F.lit(1), F.floor(F.col("n") * n / F.col("total"))), "rest": F.col("n") * n % F.col("total")})
    every = Window.partitionBy(F.lit(0))  # as many rows as strata
    more = share.withColumn("left", F.greatest(F.lit(0), F.lit(n) - F.sum("base").over(every))).withColumn("turn", F.row_number().over(every.orderBy(F.desc("rest"), stratum)))
    quota = more.select(stratum, F.least(F.col("n"), F.col("base") + F.when(F.col("turn") <= F.col("left"), 1).otherwise(0)).alias("quota"))
    ranked = rows.select(stratum, key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("order"))
    # Rows that cannot be among the first n of their stratum go before the rank is taken.
    pick = ranked.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy("order", key))).where(F.col("turn") <= n)
    return pick.join(F.broadcast(quota), stratum).where("turn <= quota").select(stratum, key, "turn")


def slices(rows: DataFrame, group: str, position: str, key: str, k: int = 3, seed: str = "7") -> DataFrame:
    """One row of each of ``k`` equal slices of a group's positions: that with the least hash."""
    ends = rows.groupBy(group).agg(F.max(position).alias("last"))
    at = rows.join(ends, group).withColumn("slice", F.floor((F.col(position) - 1) * k / F.col("last")))
    return at.groupBy(group, "slice").agg(F.min_by(key, F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), F.col(key))).alias(key))


def rarity(rows: DataFrame, key: str, tags: str) -> DataFrame:
    """How rare the tags of each row are: the sum of millionths of 1 / frequency, and how many tags it has."""
    long = rows.select(key, F.explode(F.split(tags, ";")).alias("tag"))
    often = long.groupBy("tag").agg(F.count("*").alias("n"))
    return long.join(often, "tag").groupBy(key).agg(F.sum(F.floor(F.lit(1000000) / F.col("n"))).alias("rarity"), F.count("*").alias("n_tags"))
