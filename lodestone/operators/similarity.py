"""Similarity of bit sets: pairs, nearest neighbours, and the applicability domain of a training set."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import tanimoto
from lodestone.operators.order import exact_percentile
from lodestone.operators.tables import materialise


def bit_sets(vectors: DataFrame, least: float = 0.1) -> DataFrame:
    """(vec_id, label, bits): positions whose value is above ``least``."""
    bits = F.expr(f"filter(transform(embedding, (v, i) -> if(cast(v as double) > {least}D, i, -1)), i -> i >= 0)")
    return vectors.select("vec_id", "label", bits.alias("bits"))


def pair_similarity(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tanimoto similarity of given pairs (a, b)."""
    a, b = sets.select(F.col("vec_id").alias("a"), F.col("bits").alias("a_bits")), sets.select(F.col("vec_id").alias("b"), F.col("bits").alias("b_bits"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", tanimoto(F.col("a_bits"), F.col("b_bits")).alias("similarity"))


#: Pivots that sets are placed by, sets of a chunk, rings of distance around a pivot, and the ratio of sizes within a band.
PIVOTS, CHUNK, RINGS, BAND = 32, 4096, 8, 1.5
#: Elements of a pack of queries, about, and names up to which a chunk is a matrix.
PACK, DENSE = 1024, 1024
#: What rounding may take off a bound.
SLACK = 1e-9


class _Index:
    """Inverted lists of some sets, for counting what a set shares with each of them."""

    def __init__(self, bits: list):
        self.sizes = np.array([len(b) for b in bits], dtype=np.int64)
        flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in bits]) if len(bits) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(bits)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.names, starts = np.unique(flat[order], return_index=True)
        self.lists, self.starts, self.ends, self.dense = owner[order], starts, np.append(starts[1:], len(flat)), None

    def shared(self, bits) -> np.ndarray:
        bits = np.asarray(bits, dtype=np.int64)
        at = np.searchsorted(self.names, bits)
        at = at[(at < len(self.names)) & (self.names[np.minimum(at, len(self.names) - 1)] == bits)] if len(self.names) else at[:0]
        if not len(at):
            return np.zeros(len(self.sizes), np.int64)
        return np.bincount(np.concatenate([self.lists[self.starts[k] : self.ends[k]] for k in at]), minlength=len(self.sizes))

    def shared_each(self, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """A row for each of several sets, given one after another: what it shares. With few names as a product of matrices."""
        if len(self.names) > DENSE:
            return np.stack([self.shared(b) for b in np.split(flat, np.cumsum(sizes)[:-1])])
        if self.dense is None:
            self.dense = np.zeros((len(self.names), len(self.sizes)), np.float32)
            self.dense[np.repeat(np.arange(len(self.names)), self.ends - self.starts), self.lists] = 1
        at, row = np.searchsorted(self.names, flat), np.repeat(np.arange(len(sizes)), sizes)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == flat[known]
        asked = np.zeros((len(sizes), len(self.names)), np.float32)
        asked[row[known], at[known]] = 1
        return (asked @ self.dense).astype(np.int64)

    def distances(self, bits) -> np.ndarray:
        both = self.shared(bits)
        return 1.0 - both / (self.sizes + len(bits) - both)


def _clean(sets: DataFrame) -> DataFrame:
    bits = F.sort_array(F.array_distinct(F.filter("bits", lambda x: x.isNotNull())))
    return sets.select("vec_id", bits.alias("bits")).where(F.size("bits") > 0)


def _cells(sets: DataFrame, pivots: list, chunk: int) -> tuple[DataFrame, pd.DataFrame]:
    """The sets with their cell and chunk, and the cells: ends of distance to the pivot, ends of size, and number of chunks.

    A cell is a pivot (the nearest), a band of sizes and a ring of distance, so there are as many cells as pivots times rings
    times bands at most, however many sets there are.
    """
    kind = sets.schema["vec_id"].dataType.simpleString()
    to = _Index(pivots)

    def place(batches):
        for part in batches:
            far = [to.distances(b) for b in part["bits"]]
            near = [int(d.argmin()) for d in far]
            least = np.array([d[k] for d, k in zip(far, near, strict=True)], dtype=np.float64)
            size = part["bits"].map(len).to_numpy(dtype=np.int64)
            yield part[["vec_id", "bits"]].assign(pivot=near, band=np.floor(np.log(size) / np.log(BAND)).astype(np.int64), ring=np.floor(least * RINGS).astype(np.int64), distance=least, size=size)

    key = ["pivot", "band", "ring"]
    placed = materialise(sets.mapInPandas(place, f"vec_id {kind}, bits array<long>, pivot long, band long, ring long, distance double, size long"), "placed")
    about = placed.groupBy(*key).agg(F.min("distance").alias("near"), F.max("distance").alias("far"), F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("n")).orderBy(*key).toPandas()
    about["cell"], about["chunks"] = np.arange(len(about)), -(-about["n"] // chunk)
    told = sets.sparkSession.createDataFrame(about[[*key, "cell", "chunks"]], "pivot long, band long, ring long, cell long, chunks long")
    dealt = placed.join(F.broadcast(told), key).select("cell", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).alias("chunk"), "vec_id", "bits")
    return dealt, about


def _packs(own: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Numbers of sets in runs of at most ``PACK`` elements, or one set."""
    return np.split(own, np.flatnonzero(np.diff(np.cumsum(sizes[own]) // PACK)) + 1) if len(own) else []


def _packed(queries: DataFrame, pivots: list, about: pd.DataFrame, first: bool) -> DataFrame:
    """(cell, chunk, ids, sizes, flat): where queries are to be searched for, in packs: the most promising cell of each, or after
    that all others that may hold a set at least as similar as the column ``found`` says.

    The distance of sets is a metric, so a set in a cell is at least as far as the query is from the cell's ring; and sets of
    different sizes are no more similar than their sizes are.
    """
    kind = queries.schema["vec_id"].dataType.simpleString()
    to = _Index(pivots)
    pivot, near, far, least, most, chunks = (about[k].to_numpy() for k in ("pivot", "near", "far", "least", "most", "chunks"))

    def ask(batches):
        for part in batches:
            ids, sets, to_cells = part["vec_id"].to_numpy(), part["bits"].to_list(), []
            for k, bits in enumerate(sets):
                away, size = to.distances(bits)[pivot], len(bits)
                bound = np.minimum(1.0 - np.maximum(np.maximum(away - far, near - away), 0.0), np.minimum(size / least, most / size))
                best = int(bound.argmax())
                if first:
                    cells = np.array([best])
                else:
                    cells = np.flatnonzero((bound > 0) & (bound >= part["found"].iat[k] - SLACK))
                    cells = cells[cells != best]
                to_cells.append(cells)
            sizes = np.array([len(b) for b in sets], dtype=np.int64)
            cells = np.concatenate(to_cells) if to_cells else np.empty(0, np.int64)
            order = np.argsort(cells, kind="stable")
            asking = np.repeat(np.arange(len(sets)), [len(c) for c in to_cells])[order]
            names, starts = np.unique(cells[order], return_index=True)
            rows = []
            for c, own in zip(names, np.split(asking, starts[1:]), strict=False):
                for pack in _packs(own, sizes):
                    flat = np.concatenate([sets[k] for k in pack])
                    rows += [(int(c), j, ids[pack], sizes[pack], flat) for j in range(chunks[c])]
                    if len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=["cell", "chunk", "ids", "sizes", "flat"])
                        rows = []
            yield pd.DataFrame(rows, columns=["cell", "chunk", "ids", "sizes", "flat"])

    return queries.mapInPandas(ask, f"cell long, chunk long, ids array<{kind}>, sizes array<long>, flat array<long>")


def _asked(queries: DataFrame, pivots: list, about: pd.DataFrame, first: bool) -> DataFrame:
    """(cell, chunk, vec_id): what ``_packed`` sends, a row for each query and chunk."""
    return _packed(queries, pivots, about, first).select("cell", "chunk", F.explode("ids").alias("vec_id"))


def _searched(dealt: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, tid, shared, total) of the best set of each chunk that a query was sent to; none where nothing is shared.

    A task reads the sets of a chunk, and then the queries for it, in any number, pack by pack.
    """
    kind = dealt.schema["vec_id"].dataType.simpleString()

    def search(batches):
        at, ids, sets, index = None, [], [], None
        for part in batches:
            out = []
            for cell, chunk, is_query, own, sizes, flat in zip(part["cell"], part["chunk"], part["is_query"], part["ids"], part["sizes"], part["flat"], strict=True):
                if (cell, chunk) != at:
                    at, ids, sets, index = (cell, chunk), [], [], None
                if not is_query:
                    ids.append(own[0])
                    sets.append(flat)
                    continue
                if not sets:
                    continue
                index = index or _Index(sets)
                both = index.shared_each(sizes, flat)
                union = index.sizes[None, :] + sizes[:, None] - both
                k = (both / union).argmax(axis=1)  # sets come by rising id, so of equals the least
                row = np.arange(len(k))
                both, union = both[row, k], union[row, k]
                out += [(own[i], ids[k[i]], int(both[i]), int(union[i])) for i in np.flatnonzero(both)]
            yield pd.DataFrame(out, columns=["qid", "tid", "shared", "total"])

    alone = dealt.select("cell", "chunk", F.array("vec_id").alias("ids"), F.array(F.size("bits").cast("long")).alias("sizes"), F.col("bits").alias("flat"))
    both = alone.withColumn("is_query", F.lit(False)).unionByName(asked.withColumn("is_query", F.lit(True)))
    order = both.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "is_query", "ids")
    return order.mapInPandas(search, f"qid {kind}, tid {kind}, shared long, total long").withColumn("similarity", F.col("shared") / F.col("total"))


def nearest(queries: DataFrame, train: DataFrame, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """For each query set the most similar training set, exactly: (vec_id, match, similarity to four places).

    Equal training sets count once, with their least id. Sets lie in cells by their nearest pivot, their distance to it and
    their size, in chunks of about ``chunk``. A query is first searched for in its most promising cell; what it finds there
    rules out all cells whose bound is below, and it is searched for in the others. Pivots change what is compared, never
    what is found. Of equally similar sets that with the least id is the match. A query that is null, empty, or shares no
    element with any set has similarity 0 and no match; repeated elements and nulls in a set don't count.

    The driver gets the pivots and a row for each cell. No task holds more than a chunk of sets and a batch of queries.
    """
    kind = queries.schema["vec_id"].dataType.simpleString()
    clean = _clean(train)
    # Copies may take the places of several pivots: then there are fewer.
    chosen = [list(b) for b in dict.fromkeys(tuple(r.bits) for r in clean.orderBy(F.xxhash64("bits"), "bits").limit(pivots).select("bits").collect())]
    if not chosen:
        return queries.select("vec_id", F.lit(None).cast(kind).alias("match"), F.lit(0.0).alias("similarity"))
    dealt, about = _cells(clean.groupBy("bits").agg(F.min("vec_id").alias("vec_id")), chosen, chunk)
    asking = _clean(queries).distinct()
    first = materialise(_searched(dealt, _packed(asking, chosen, about, True)), "first")
    known = asking.join(first.groupBy(F.col("qid").alias("vec_id")).agg(F.max("similarity").alias("found")), "vec_id", "left").na.fill(0.0, ["found"])
    scored = first.unionByName(_searched(dealt, _packed(known, chosen, about, False)))
    best = scored.groupBy("qid").agg(F.max_by("tid", F.struct("similarity", -F.col("tid"))).alias("match"), F.max("similarity").alias("similarity"))
    return queries.select(F.col("vec_id").alias("qid")).join(best, "qid", "left").select(F.col("qid").alias("vec_id"), "match", F.bround(F.coalesce("similarity", F.lit(0.0)), 4).alias("similarity"))


def domain(similarities: DataFrame, share: float = 0.05) -> DataFrame:
    """The similarity that a share of training sets stays below (linear interpolation), the least and the mean.

    The similarities are written once; the threshold is an exact order statistic by rounds of histograms, so no task holds all
    distinct values.
    """
    own = materialise(similarities.select("similarity"), "similarities")
    threshold = F.bround(F.lit(exact_percentile(own, "similarity", share)).cast("double"), 6)
    mean = F.bround(F.sum(F.col("similarity").cast("decimal(18,4)")).cast("double") / F.count("*"), 6)
    return own.agg(F.min("similarity").alias("least"), mean.alias("mean"), F.count("*").alias("n")).select(threshold.alias("threshold"), "least", "mean", "n")
