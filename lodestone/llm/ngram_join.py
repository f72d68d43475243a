"""N-gram Jaccard join: documents link when their word-shingle sets are similar; found by T-occurrence search.

1. Each text becomes the set of its word shingles (56-bit hashes). Texts with equal sets form a class, so exact copies
   cost nothing further. Words and shingles that a task meets often are counted over all tasks.
2. A set of n shares l shingles with any similar one among the first n - ceil(s n) + l of a common order, in both. The order
   starts with shingles of rare words, which hardly two unrelated texts have in common, and ends with frequent shingles.
   Prefix entries are sorted by shingle and size, in Spark; entries next to each other whose sizes allow a link are a run.
   Documents with fewer than l entries in runs of two or more link with nothing and go. The pairs of short runs are counted:
   two documents may link only if they meet l times, or if both also lie in long runs. A long run is joined to its first
   entry (a star, not all pairs). The connected components of these pairs and stars, the clusters, say which documents
   are searched near each other. Entries of a very frequent shingle are dealt over several tasks; their stars meet in a node
   of the shingle.
3. The sets of a cluster are dealt over blocks of bounded size, and each block is searched within, together with a few
   leaders of the cluster: T-occurrence search with DivideSkip (``t_occurrence``). What links to a leader is connected
   across blocks, so a group of near copies of any size costs one look-up each.
4. Documents of a cluster that are not connected to its largest component then go to those other blocks that hold a document
   which shares l prefix entries with them, and are searched there. So sets are sent by open candidates, not by all blocks.
5. Links of all blocks give the components.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, join_counted, materialise, small_batches, whole
from lodestone.llm.filters import bloom, tested
from lodestone.llm.slices import slices, texts_of
from lodestone.llm.t_occurrence import Across, search, smallest
from lodestone.operators.graph import components

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A task reports shingles that it meets so often in a window of its texts, and words that occur so often in a slice.
WINDOW_FREQUENT, SLICE_WORDS = 3, 8
#: Shingles of a window, about, and counters for them (two bytes each).
WINDOW, COUNTERS = 2_000_000, 1 << 23
#: The most frequent shingles and words that every task knows: 16 bytes each.
FREQUENT, WORDS = 500_000, 50_000
#: Shingles shared by fewer sets than this are never called frequent.
LEAST_FREQUENT = 8
_LOW = np.uint64((1 << 56) - 1)
#: Documents of a block, and shingles of a block (8 bytes each), about.
CELL_DOCS, CELL_SHINGLES = 256, 250_000
#: Leaders of a cluster that are searched with each of its blocks.
LEADERS = 4
#: Entries of a short run, at most: its pairs are counted.
SHORT = 8
#: Entries of one shingle that a task gets, about.
SHINGLE_ENTRIES = 8_192
#: Prefixes are longer by one shingle for so many of a set; as many must be shared.
EXTRA = 20


def shingle_sets(texts: pa.Array, size: int, levels: tuple[np.ndarray, np.ndarray] | None = None, counted: Counter | None = None) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; texts with fewer words than ``size`` have one shingle, or none.

    A shingle is a 56-bit hash; with ``levels`` (sorted word hashes, how frequent each is) the eight bits above it add up
    the levels of its words, so that shingles of rare words come first. ``counted`` gets the frequent words of the texts.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    offsets = np.asarray(parts.offsets).astype(np.int64)
    flat = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    words = flat.dictionary.to_pylist()
    codes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    index = flat.indices.to_numpy(zero_copy_only=False)
    there = np.array([bool(w) for w in words], dtype=bool)[index] if len(words) else np.zeros(0, bool)
    bounds = np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]]
    index = index[there]
    code = codes[index]
    if counted is not None:
        n = np.bincount(index, minlength=len(words))
        often = n >= SLICE_WORDS
        counted.update(dict(zip(codes[often].tolist(), n[often].tolist(), strict=True)))
    rolled = np.zeros(max(0, len(code) - size + 1), dtype=np.uint64)
    for k in range(size):
        rolled = (rolled ^ code[k : k + len(rolled)]) * _M1
        rolled ^= rolled >> np.uint64(29)
    rolled *= _M2
    rolled = (rolled ^ rolled >> np.uint64(32)) & _LOW
    if levels is not None and len(levels[0]) and len(codes):
        at = np.minimum(np.searchsorted(levels[0], codes), len(levels[0]) - 1)
        level = np.where(levels[0][at] == codes, levels[1][at], 0).astype(np.uint64)[index]
        high = np.zeros(len(rolled), dtype=np.uint64)
        for k in range(size):
            high += level[k : k + len(rolled)]
        rolled |= np.minimum(high, np.uint64(255)) << np.uint64(56)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(code[a:b].tobytes(), seed=b - a)], dtype=np.uint64) & _LOW)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def extra(n: int) -> int:
    """How many shingles two linked sets must share in their prefixes, if neither is smaller than ``n``."""
    return max(1, n // EXTRA)


def class_of(s: np.ndarray) -> int:
    """A hash of a set, whatever its order."""
    h = ((s & _LOW) + _M1) * _M2
    h = (h ^ h >> np.uint64(31)) * _M1
    h ^= h >> np.uint64(29)
    return int(((h * _M2).sum(dtype=np.uint64) ^ np.uint64(len(s))).view(np.int64))


class _Often:
    """Which shingles a task meets often, by two small tables of counters: no count is too low but where two new ones collide."""

    def __init__(self):
        self.tables, self.met = np.zeros((2, COUNTERS), dtype=np.uint8), 0

    def met_often(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often to report each of the distinct ``shingles`` of a slice; 0 for those that are not frequent."""
        if self.met > WINDOW:
            self.tables[:], self.met = 0, 0
        self.met += len(shingles)
        least = None
        for k, table in enumerate(self.tables):
            at = (shingles >> np.uint64(24 * k) & np.uint64(COUNTERS - 1)).astype(np.int64)
            table[at] = np.minimum(table[at] + counts, 255)
            least = table[at].astype(np.int64) if least is None else np.minimum(least, table[at])
        # What was met before a shingle became frequent is reported with it.
        return np.where(least >= WINDOW_FREQUENT, np.where(least - counts < WINDOW_FREQUENT, np.maximum(least, counts), counts), 0)


def _profiles(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Rows of three kinds: (id, key, n, class) for each document; (count as n, hash as class) of a shingle or word."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        frequent = _Often()
        for rows in slices(batches, 2):
            words: Counter = Counter()
            sets = shingle_sets(texts_of(rows.column(2)), size, counted=words)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            classes = np.array([class_of(s) for s in sets], dtype=np.int64)
            _, first = np.unique(classes, return_index=True)
            shingles, counts = np.unique(np.concatenate([sets[i] for i in first]), return_counts=True)
            counts = frequent.met_often(shingles, counts)
            often = counts > 0
            more = [np.fromiter(x, dtype=np.uint64, count=len(words)).view(np.int64) for x in (words.values(), words)]
            kinds = np.repeat([0, 1, 2], [len(n), int(often.sum()), len(words)]).astype(np.int32)
            ids, keys = (pa.concat_arrays([rows.column(i), pa.nulls(len(kinds) - len(n), rows.column(i).type)]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [ids, keys, pa.array(np.concatenate([n, counts[often], more[0]])), pa.array(np.concatenate([classes, shingles[often].view(np.int64), more[1]])), pa.array(kinds)],
                names=["id", "key", "n", "class", "kind"],
            )

    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(whole(text_col)).alias("key"), whole(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, key long, n long, class long, kind int")


def _top(found: DataFrame, kind: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` hashes of a kind with their counts over all tasks, sorted by hash."""
    often = found.where(F.col("kind") == kind).groupBy("class").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = often.orderBy(F.desc("n"), "class").limit(most).toPandas()
    hashes = top["class"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], top["n"].to_numpy(dtype=np.int64)[order]


def prefix(s: np.ndarray, percent: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones in their order, then frequent ones from the rarest; see ``extra``."""
    length = min(len(s), len(s) - smallest(len(s), percent) + extra(len(s)))
    if not len(frequent):
        return s[:length]
    for tried in (s[: 2 * length], s):
        low = tried & _LOW
        at = np.minimum(np.searchsorted(frequent, low), len(frequent) - 1)
        often = frequent[at] == low
        rare = tried[~often]
        if len(rare) >= length:
            return rare[:length]
    common = s[often]
    return np.concatenate([rare, common[np.argsort(rank[at[often]], kind="stable")[: length - len(rare)]]])


def _runs(t: np.ndarray, part: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Where runs start in sorted entries: at a new shingle or part, or where sizes are too far apart to link across."""
    start = np.ones(len(t), dtype=bool)
    start[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1]) | (100 * n[:-1] < percent * n[1:])
    return start


def _shared(batches, percent: int):
    """The entries (shingle, part, n, class) of a sorted stream that lie in runs of two or more, and all of split shingles."""
    held = [np.zeros(0, dtype=np.int64)] * 4
    names = ["shingle", "part", "n", "class"]
    joined = False  # whether the row that was held back has one of its run before it
    for rows in batches:
        if rows.num_rows:
            own = [np.concatenate([h, rows.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            # Exact copies in several tasks bring an entry several times.
            new = np.ones(len(own[0]), dtype=bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in own])
            own = [x[new] for x in own]
            start = _runs(*own[:3], percent)
            near = ~start
            near[:-1] |= ~start[1:]
            near |= own[1] > 0
            near[0] |= joined
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][near[:-1]]) for x in own], names=names)
            held, joined = [x[-1:] for x in own], bool(near[-1])
    if joined:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=names)


def _meetings(batches, percent: int):
    """Where entries (shingle, part, n, class) of a sorted stream meet: rows (kind, a, b, least).

    Kind 0 is a pair of a short run, with how often it must meet; kind 1 joins an entry of a long run to the run's first, or that
    to the shingle's node; kind 2 is a class in a long run. All runs of split shingles are long.
    """
    held, long = [np.zeros(0, dtype=np.int64)] * 4, None  # rows of a run that may go on; (shingle, part, n, first) of a long one

    def met(own, last):
        nonlocal held, long
        t, part, n, c = own
        if not len(t):
            return None
        start = _runs(t, part, n, percent)
        goes_on = long is not None and t[0] == long[0] and part[0] == long[1] and 100 * long[2] >= percent * n[0]
        first = np.flatnonzero(start)
        length = np.diff(first, append=len(t))
        is_long = (length > SHORT) | (part[first] > 0)
        is_long[0] |= goes_on
        if not last and not is_long[-1]:
            held = [x[first[-1] :] for x in own]
            t, part, n, c = (x[: first[-1]] for x in own)
            first, length, is_long = first[:-1], length[:-1], is_long[:-1]
            if not len(t):
                return None
        else:
            held = [x[:0] for x in own]
        run = np.repeat(np.arange(len(first)), length)
        far = is_long[run]
        head = c[first]
        if goes_on:
            head[0] = long[3]
        long = (t[-1], part[-1], n[-1], head[-1]) if far[-1] else None
        found = []
        for d in range(1, SHORT):
            i = np.flatnonzero((run[d:] == run[:-d]) & ~far[d:] & (c[d:] != c[:-d])) if len(t) > d else np.zeros(0, np.int64)
            x, y = c[i], c[i + d]
            least = np.maximum(1, np.minimum(n[i], n[i + d]) // EXTRA)
            found.append(np.stack([np.zeros(len(i), np.int64), np.minimum(x, y), np.maximum(x, y), least]))
        joined = np.flatnonzero(far & (c != head[run]))
        split = np.flatnonzero(is_long & (part[first] > 0))
        for kind, x, y in ((1, c[joined], head[run[joined]]), (1, head[split], _node(t[first[split]])), (2, c[far], c[far])):
            found.append(np.stack([np.full(len(x), kind), x, y, np.zeros(len(x), np.int64)]))
        return np.concatenate(found, axis=1)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["kind", "a", "b", "least"])

    for rows in batches:
        if rows.num_rows and (found := met([np.concatenate([h, rows.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)], False)) is not None:
            yield batch(found)
    if (found := met(held, True)) is not None:
        yield batch(found)


def edges(entries: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) whose components hold every link: pairs that meet often enough, and the stars of long runs."""
    rows = _sorted(entries).mapInArrow(lambda batches: _meetings(batches, percent), "kind long, a long, b long, least long")
    counted = materialise(rows.groupBy("kind", "a", "b", "least").agg(F.count("*").alias("n")), "meetings")
    far = counted.where("kind = 2")
    n_far = far.count()
    # Whether both of a pair lie in long runs: by a filter, so that no pair moves. Where it errs, a pair is kept.
    known = bloom(far.select(F.xxhash64("a").alias("h")), n_far)
    pairs = counted.where("kind = 0")
    asked = tested(tested(pairs.where("n < least"), F.xxhash64("a"), known, "a_far"), F.xxhash64("b"), known, "b_far").where("a_far and b_far")
    return pairs.where("n >= least").select("a", "b").unionByName(asked.select("a", "b")).unionByName(counted.where("kind = 1").select("a", "b"))


def _node(shingles: np.ndarray) -> np.ndarray:
    """A node for each split shingle, to which the stars of its parts are joined. It is no class: joins with classes drop it."""
    return shingles ^ np.int64(0x5BD1E9955BD1E995)


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.repartition("shingle", "part").sortWithinPartitions("shingle", "part", "n", "class")


def _least_shared(n, percent: int):
    """As a column: how many prefix entries a set of ``n`` shares with any set it links to, at least."""
    return F.greatest(F.lit(1), F.floor(F.floor((n * percent + 99) / 100) / EXTRA))


def candidates(entries: DataFrame, percent: int) -> DataFrame:
    """The prefix entries (shingle, part, n, class) of documents that may link, as a table; see the module's text."""
    schema = "shingle long, part long, n long, class long"
    near = materialise(_sorted(entries).mapInArrow(lambda batches: _shared(batches, percent), schema), "entries")
    alive = materialise(near.groupBy("class", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= _least_shared(F.col("n"), percent)).select("class"), "alive")
    # A filter, so that no entry moves; the few that it lets through are candidates more.
    kept = materialise(tested(near, F.xxhash64("class"), bloom(alive.select(F.xxhash64("class").alias("h")), alive.count()), "alive").where("alive").select("shingle", "part", "n", "class"), "entries")
    discard(near, alive)
    return kept


_CELL = ("cluster", "block", "part")


def _cells(batches, percent: int, across: bool):
    """Search each cell of a stream of (cluster, block, part, side, root, class, set), sorted in this order. Yields links (a, b).

    Without ``across`` the sets of a cell are searched among themselves. With it those of side 0 are the block, held in memory,
    and those of side 1 queries, taken one by one.
    """
    key, classes, roots, sets, block = None, [], [], [], None
    a: list[int] = []
    b: list[int] = []

    def close() -> None:
        if not across and len(sets) > 1:
            found = search(sets, percent)
            linked = np.flatnonzero(found != np.arange(len(found))).tolist()
            a.extend(classes[i] for i in linked)
            b.extend(classes[i] for i in found[linked])

    for rows in batches:
        columns = [rows.column(i).to_pylist() for i in range(6)]
        for *own, side, root, c, s in zip(*columns, rows.column(6).to_pylist(), strict=True):
            if own != key:
                close()
                key, classes, roots, sets, block = own, [], [], [], None
            if side:
                block = block or Across(sets, roots, percent)
                for x in block.links(np.frombuffer(s, dtype=np.uint64), root):
                    a.append(c)
                    b.append(classes[x])
            elif not classes or classes[-1] != c:  # repeated rows bring their class again
                classes.append(c)
                roots.append(root)
                sets.append(np.frombuffer(s, dtype=np.uint64))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear()
            b.clear()
    close()
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _searched(cells: DataFrame, percent: int, across: bool) -> DataFrame:
    dealt = cells.select(*_CELL, "side", "root", "class", "set").repartition(*_CELL).sortWithinPartitions(*_CELL, "side", "class")
    return dealt.mapInArrow(lambda batches: _cells(batches, percent, across), "a long, b long")


def _placed(member: DataFrame, cell_docs: int, total: int) -> DataFrame:
    """Members of clusters with the number of their cluster's blocks, their own block, and whether they lead.

    The first leader is a set of the greatest share of prefix entries in common with others, the rest have the least hashes.
    """
    n_blocks = F.greatest(F.ceil(F.count("*") / cell_docs), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("int")
    by_hash = [F.min_by("class", F.xxhash64("class", F.lit(k))) for k in range(1, LEADERS)]
    best = F.max_by("class", F.struct(F.col("shared") / F.col("n"), F.xxhash64("class")))
    clusters = member.groupBy("cluster").agg(F.count("*").alias("size"), n_blocks.alias("blocks"), F.array(best, *by_hash).alias("leaders"))
    joined = join_counted(member, clusters, "cluster", "size", total)
    block = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    return joined.withColumns({"block": block, "leads": F.array_contains("leaders", F.col("class")) & (F.col("blocks") > 1)}).drop("leaders")


def _asked(entries: DataFrame, spread: DataFrame, percent: int) -> DataFrame:
    """(class, cluster, block): the other blocks in which a member that is not in its cluster's main component must be searched."""
    of = lambda rows, column: bloom(rows.select(F.xxhash64(column).alias("h")), rows.count())
    opened = spread.where("open")
    asking = tested(entries, F.xxhash64("class"), of(opened, "class"), "asks").where("asks").select("class", "n", "shingle").distinct()
    asking = materialise(asking.join(opened.select("class", "cluster", "block"), "class"), "asking")
    # Only entries of shingles that are asked for, and of members of spread clusters, are joined.
    near = tested(tested(entries, F.xxhash64("shingle"), of(asking, "shingle"), "wanted").where("wanted"), F.xxhash64("class"), of(spread, "class"), "spread").where("spread")
    holders = near.select("class", "shingle").join(spread.select("class", "cluster", F.col("block").alias("other")), "class").select("shingle", "cluster", "other").distinct()
    shared = asking.join(holders, ["shingle", "cluster"]).where("block <> other")
    counted = shared.groupBy("class", "n", "cluster", "other").agg(F.count("*").alias("shared"))
    return counted.where(F.col("shared") >= _least_shared(F.col("n"), percent)).select("class", "cluster", F.col("other").alias("block"))


def _links(sets: DataFrame, entries: DataFrame, placed: DataFrame, percent: int, total: int) -> DataFrame:
    """Links (a, b) between classes, enough to connect all that links connect. ``sets``: (class, set)."""
    # The plan that large inputs have, at any size.
    dealt = sets.join(placed.select("class", "cluster", "blocks", "block", "leads").hint("merge"), "class")
    to = F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    plain = {"part": F.lit(0), "side": F.lit(0), "root": F.col("class")}
    first = materialise(_searched(dealt.withColumns(plain).withColumn("block", F.explode(to)), percent, False), "links")
    wide = placed.where("blocks > 1").select("class", "cluster", "block", "size")
    if wide.isEmpty():
        return first

    roots = components(first).withColumnRenamed("node", "class")
    rooted = materialise(wide.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "rooted")
    main = rooted.groupBy("cluster", "root", "size").agg(F.count("*").alias("n")).groupBy("cluster", "size").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    spread = join_counted(rooted.drop("size"), main, "cluster", "size", total)
    spread = materialise(spread.select("class", "cluster", "block", "root", (F.col("root") != F.col("main")).alias("open")), "spread")
    asked = materialise(_asked(entries, spread, percent), "asked")
    if asked.isEmpty():
        return first
    # The queries of a block are dealt over several cells, each with a copy of the block.
    targets = asked.groupBy("cluster", "block").agg(F.ceil(F.count("*") / (4 * CELL_DOCS)).cast("int").alias("parts"))
    known = sets.join(spread.hint("merge"), "class")
    block = known.join(targets, ["cluster", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
    queries = known.where("open").drop("cluster", "block").join(asked.join(targets, ["cluster", "block"]), "class")
    queries = queries.withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("side", F.lit(1))
    columns = [*_CELL, "side", "root", "class", "set"]
    return first.unionByName(materialise(_searched(block.select(columns).unionByName(queries.select(columns)), percent, True), "links"))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, cell_docs: int = CELL_DOCS) -> DataFrame:
    """(id, key, n_shingles, component_id, first) for each row of ``docs``.

    Two documents link when the sets of their ``size``-word shingles have an intersection of at least ``percent`` per cent
    of their union; ``component_id`` is the smallest id that links reach. ``key`` is a hash of the text; ``first`` marks the
    smallest (id, key) of the component. No candidate is left out; what is compared are hashes, of 56 bits for a shingle and
    64 for a set: of a thousand million different sets, some pair is taken for equal with a chance of about 3 in 100.

    - Words are lower case in A-Z and end at ASCII white space. A text of fewer words than ``size`` is one shingle.
    - Null and empty texts, and texts without a word, have the empty set and link with nothing, not even each other.
    - Equal sets (exact copies, repeated rows) are one component. A null id is never the smallest; a component of null ids
      only has a null ``component_id``.
    - Very long texts: memory follows the longest text; an empty table gives an empty result; other columns aren't read.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    found = materialise(_profiles(docs, id_col, text_col, size), "profiles")
    rows = found.where("kind = 0").select("id", "key", "n", "class")
    frequent = _top(found, 1, LEAST_FREQUENT, FREQUENT)
    words, counts = _top(found, 2, SLICE_WORDS, WORDS)
    levels = words, np.clip(2 * np.log2(np.maximum(counts, 1) / SLICE_WORDS), 0, 255 // size)
    known = spark.sparkContext.broadcast((frequent, (levels[0], levels[1].astype(np.uint8))))

    def prefixes(batches):
        (shingles, rank), levels = known.value
        for part in slices(batches, 0):
            sets = {class_of(s): s for s in shingle_sets(texts_of(part.column(0)), size, levels) if len(s)}
            out = [prefix(s, percent, shingles, rank) for s in sets.values()]
            n = [len(p) for p in out]
            shingle, classes = np.concatenate([*out, np.zeros(0, np.uint64)]), np.repeat(np.array(list(sets), dtype=np.int64), n)
            parts = np.zeros(len(shingle), dtype=np.int64)
            if len(shingles) and len(shingle):
                at = np.minimum(np.searchsorted(shingles, shingle & _LOW), len(shingles) - 1)
                split = np.where(shingles[at] == shingle & _LOW, 1 + rank[at] // SHINGLE_ENTRIES, 1)
                parts = np.where(split > 1, 1 + classes % split, 0)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(parts), pa.array(np.repeat(np.array([len(s) for s in sets.values()], dtype=np.int64), n)), pa.array(classes)], names=["shingle", "part", "n", "class"])

    texts = docs.select(whole(text_col).alias("text"))
    entries = candidates(texts.mapInArrow(prefixes, "shingle long, part long, n long, class long"), percent)
    total = rows.count()
    clusters = components(edges(entries, percent)).withColumnsRenamed({"node": "class", "root": "cluster"})
    # One row of each class in a cluster brings its set.
    one = rows.where("n > 0").groupBy("class", "n").agg(F.min(F.struct("key", "id")).alias("one"))
    often = entries.groupBy("class").agg(F.count("*").alias("shared"))
    member = one.join(clusters, "class").join(often, "class").select("class", "n", "shared", "cluster", F.col("one.key").alias("own_key"), F.col("one.id").alias("own_id"))
    placed = materialise(_placed(materialise(member, "members"), cell_docs, total), "placed")

    def sets_of(batches):
        for part in slices(batches, 0):
            sets = shingle_sets(texts_of(part.column(0)), size)
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "set"])

    # Texts that bring no set are ruled out where they lie.
    text = docs.select(F.xxhash64(F.xxhash64(whole(text_col)), F.col(f"`{id_col}`")).alias("own"), whole(text_col).alias("text"))
    bearers = bloom(placed.select(F.xxhash64("own_key", "own_id").alias("h")), placed.count())
    bearing = tested(text, F.col("own"), bearers, "bears").where("bears").select("text")
    sets = materialise(bearing.mapInArrow(sets_of, "class long, set binary"), "sets")
    roots = components(_links(sets, entries, placed, percent, total))

    low = rows.where("n > 0").groupBy("class").agg(F.min("id").alias("id"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "key"))).alias("first"), F.min("key").alias("key"), F.count("*").alias("size"))
    own = materialise(low.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class")), "classes")
    least = materialise(own.groupBy("root").agg(F.min("id").alias("component_id"), F.min("first").alias("first"), F.min("key").alias("least_key"), F.count("*").alias("n_classes")), "roots")
    named = join_counted(own.select("class", "root", "size"), least, "root", "n_classes", total).select("class", "size", "component_id", "first", "least_key")
    named = materialise(named, "named")
    empty = rows.where("n = 0").select("*", *[F.lit(None).cast(named.schema[c].dataType).alias(c) for c in named.columns if c != "class"])
    marked = join_counted(rows.where("n > 0"), named, "class", "size", total).unionByName(empty)
    lone = F.col("n") == 0
    is_first = F.when(F.col("first").isNotNull(), F.col("first") == F.struct("id", "key")).otherwise(F.col("least_key") == F.col("key"))
    return marked.select("id", "key", F.col("n").alias("n_shingles"), F.when(lone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(lone, F.lit(True)).otherwise(F.coalesce(is_first, F.lit(False))).alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, with all columns; see ``link_documents``.

    Rows with equal id and text are one document and stay together. Columns may have any names. A filter of the documents
    that go rules out most others where they lie; only what it may hold is joined.
    """
    gone = materialise(link_documents(docs, id_col, text_col, **options).where("not first").select(F.col("id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(), "gone")
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    id_col, text_col = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    keyed = safe.withColumn("key", F.xxhash64(whole(text_col)))
    marked = tested(keyed, F.xxhash64("key", id_col), bloom(gone.select(F.xxhash64("gone_key", "gone_id").alias("h")), gone.count()), "may_go")
    asked = marked.where("may_go").join(gone, (F.col("key") == F.col("gone_key")) & F.col(id_col).eqNullSafe(F.col("gone_id")), "left_anti")
    kept = marked.where("not may_go").unionByName(asked)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
