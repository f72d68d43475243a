"""Duplicates: first-seen marking, keep-first over two keys, near duplicates by bit distance, lookups over several keys."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.folds import fold
from lodestone.operators.graph import components
from lodestone.operators.tables import discard, materialise


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Rows with the first of their key and whether they repeat it. The first comes from a partial minimum, not a sort."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    return rows.join(firsts, key).withColumn("repeats", F.col(order) != F.col("first"))


def distinct_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The distinct keys with the first row of each, by which they are in order."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def duplicate_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """For each key column: groups of two rows or more, and how many rows are surplus."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select("k.*").where("value is not null and value <> ''")
    groups = long.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1")
    return groups.groupBy("key").agg(F.count("*").alias("n_groups"), F.sum(F.col("n") - 1).alias("n_surplus"))


def earliest_match(rows: DataFrame, order: str, *keys: str) -> DataFrame:
    """For each row the earliest earlier row that shares any of the keys (null if none)."""
    found = None
    for k in keys:
        firsts = rows.where(F.col(k).isNotNull() & (F.col(k) != "")).groupBy(k).agg(F.min(order).alias("at"))
        own = rows.select(order, k).join(firsts, k, "left").select(order, "at")
        found = own if found is None else found.unionByName(own)
    return found.groupBy(order).agg(F.min(F.when(F.col("at") < F.col(order), F.col("at"))).alias("match"))


class _FirstOfTwo:
    """Keys of the rows kept so far."""

    def __init__(self, a: str, b: str):
        self.a, self.b, self.seen_a, self.seen_b = a, b, set(), set()

    def take(self, order, x, y):
        if x is not None and x in self.seen_a:
            return ((order, "duplicate_" + self.a),)
        if y is not None and y in self.seen_b:
            return ((order, "duplicate_" + self.b),)
        self.seen_a.add(x)
        self.seen_b.add(y)
        return ((order, ""),)

    def end(self):
        return ()


def _fold_components(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The rows (order, a, b) that the fold keeps, each connected component by itself as a stream."""
    node = lambda k, c: F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(k), F.col(c).cast("string")))
    named = rows.select("order", "a", "b", node("a", "a").alias("node_a"), node("b", "b").alias("node_b"))
    roots = components(named.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    at = named.withColumn("node", F.coalesce("node_a", "node_b")).join(roots, "node", "left")
    placed = at.select(F.coalesce("root", "node").alias("component"), "order", "a", "b")
    kept = fold(placed, "component", ["order"], lambda _: _FirstOfTwo(a, b), f"order {rows.schema['order'].dataType.simpleString()}, reason string").where("reason = ''")
    return rows.join(kept.select("order"), "order", "left_semi")


def keep_first_two_keys(rows: DataFrame, order: str, a: str, b: str, rounds: int = 24) -> DataFrame:
    """Rows kept in order unless an earlier kept row has their ``a`` or ``b``; a dropped row reserves neither. (order, reason)

    Works in rounds over the rows not yet decided: a row that is the first with its ``a`` and the first with its ``b`` stays, and
    the rows that share a key with it go. Firsts come from partial minima, so no key's rows meet in a task; a key that a third
    of all rows has is settled in the round that keeps its first row. In an order that has nothing to do with the keys the
    rows left fall quickly; only chains of keys in rising order take a round for each two links, and what is left after
    ``rounds`` is folded by connected component.

    ``order`` tells rows apart. A null key is equal to none and reserves nothing; a row of two null keys is kept. The reason is
    empty for kept rows, else it names ``a`` where an earlier kept row has it, and otherwise ``b``.
    """
    named = materialise(rows.select(F.col(order).alias("order"), F.col(a).alias("a"), F.col(b).alias("b")), "two-keys")
    kept, left = [named.where("a is null and b is null")], named.where("a is not null or b is not null")
    first = lambda df, k, other: df.where(f"{k} is not null").groupBy(k).agg(F.min_by(other, "order").alias(other), F.min("order").alias("order"))
    written = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        by_a, by_b = first(left, "a", "b").select("order", "a", "b"), first(left, "b", "a").select("order", "a", "b")
        now = by_a.where("b is null").unionByName(by_b.where("a is null")).unionByName(by_a.join(by_b.select("order"), "order", "left_semi"))
        now = materialise(now, "kept")
        kept.append(now)
        after = left.join(now.where("a is not null").select("a"), "a", "left_anti").join(now.where("b is not null").select("b"), "b", "left_anti")
        left = materialise(after.select("order", "a", "b"), "undecided")
        if written is not None:
            discard(written)
        written = left
    else:
        kept.append(_fold_components(left, a, b))
    stay = kept[0]
    for k in kept[1:]:
        stay = stay.unionByName(k)
    stay = materialise(stay, "stay")
    by = {c: stay.where(f"{c} is not null").select(F.col(c), F.col("order").alias(f"first_{c}")) for c in ("a", "b")}  # one row for each value
    told = named.join(by["a"], "a", "left").join(by["b"], "b", "left")
    earlier = lambda c: F.coalesce(F.col(f"first_{c}") < F.col("order"), F.lit(False))
    reason = F.when(earlier("a"), f"duplicate_{a}").when(earlier("b"), f"duplicate_{b}").otherwise("")
    return told.select(F.col("order").alias(order), reason.alias("reason"))


def near(rows: DataFrame, order: str, bits: str, group: str, distance: int = 3, spare: int = 3) -> DataFrame:
    """For each row whose 64-bit hash is within ``distance`` bits of an earlier row's of its group: the earliest such row.

    Hashes are cut into ``distance + spare`` parts. Those that differ in at most ``distance`` bits agree in some ``spare`` parts:
    a join for each choice of so many parts (with 3 of 6, twenty keys of about 32 bits), then the exact distance. Equal hashes
    of a group meet once, through their first row, and of two hashes only the later looks for the earlier.
    """
    n = distance + spare
    ends = [64 * k // n for k in range(n + 1)]
    masks = [sum(((1 << (ends[k + 1] - ends[k])) - 1) << ends[k] for k in chosen) for chosen in combinations(range(n), spare)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    firsts = rows.groupBy(group, bits).agg(F.min(order).alias("first"))
    parts = F.array(*[F.struct(F.lit(k).alias("choice"), F.col(bits).bitwiseAND(F.lit(signed(m)).cast("long")).alias("part")) for k, m in enumerate(masks)])
    cut = firsts.withColumn("p", F.explode(parts)).select(group, bits, "first", "p.choice", "p.part")
    x, y = cut.alias("x"), cut.alias("y")
    close = x.join(y, [group, "choice", "part"]).where((F.col("y.first") < F.col("x.first")) & (F.bit_count(F.col(f"x.{bits}").bitwiseXOR(F.col(f"y.{bits}"))) <= distance))
    least = close.groupBy(group, F.col(f"x.{bits}").alias(bits)).agg(F.min("y.first").alias("earlier"))
    known = firsts.join(least, [group, bits], "left").select(group, bits, F.least("first", "earlier").alias("match"))
    return rows.join(known, [group, bits]).where(F.col("match") < F.col(order)).select(order, "match")


def sign_bits(vector: str, n: int = 64) -> Column:
    """A 64-bit hash of a vector: bit i is set where element i is not negative."""
    return F.expr(f"aggregate(sequence(0, {n - 1}), 0L, (h, i) -> h | if(get({vector}, i) >= 0, shiftleft(1L, i), 0L))")
