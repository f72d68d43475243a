"""Connected components of an edge table, by alternating large and small stars.

Each round replaces edges by edges to smaller nodes, so paths halve; the table of edges is written after each round and
read back, which cuts the lineage, and the one before it is deleted. A node with very many edges meets them in a partial
minimum and in a join that the engine can split, never in one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.tables import discard, materialise, shared_dir  # noqa: F401


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of its neighbours and itself."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. Edges run from larger to smaller nodes."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    turned = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return turned.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b): the root is the smallest node that it reaches.

    Loops and repeated edges do no harm; an edge with a null end is left out. No edge gives an empty result. A node whose
    only edge is a loop has no row.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, state = materialise(ordered.distinct(), "edges"), None
    for _ in range(rounds):
        after = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == state:
            break
        state = after
        stepped = materialise(_small(_large(now).distinct()).distinct(), "edges")
        discard(now)
        now = stepped
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
