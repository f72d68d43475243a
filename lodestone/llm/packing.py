"""Best-fit packing of tokenised documents into sequences of a fixed length.

1. Each document is tokenised in its task, ended, and cut only where it is longer than a sequence. A row for each piece
   goes to a table, with the task's number and the piece's turn among the task's pieces of the same length.
2. Only the number of pieces of each length (at most ``capacity`` numbers) matters for packing, and reaches the driver.
   Pieces of more than a third of a sequence are matched greedily, at most two in a sequence: each, from the longest, with
   the longest that still fits. Smaller pieces, from the longest, go where they leave the smallest gap. This runs over
   groups of equal sequences, so its work depends on ``capacity``, not on the number of documents.
3. The turn of a piece among all of its length is its turn in its task plus the sum of earlier tasks' counts. The plan maps
   ranges of turns to places. No row is moved to be placed.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import materialise, resident, small_batches, whole
from lodestone.llm.slices import between_spaces, slices, texts_of

#: Distinct units whose ids a worker keeps (about 200 bytes each); then it starts anew.
CACHE = 200_000
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


class ByteBpe:
    """Ids of whole texts by a byte-level BPE vocabulary, unit by unit.

    A unit is a space and what follows up to the next. The splitting pattern of the vocabulary never joins characters
    across a unit's start unless a space stands inside a run of white space; such texts, and those that name a special
    token, are encoded whole by the library. The distinct other units of a slice are encoded once, many in one call, by
    the same vocabulary in its rank form; a token that begins with a space starts the next unit.
    """

    def __init__(self, path: str, ranks_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.starts = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.starts[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, tuple[int, int]] = {}
        self.pool, self.used = np.empty(1 << 18, dtype=np.uint32), 0

    def add(self, ids: np.ndarray) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def learn(self, units: list[str]) -> None:
        """Keep the ids of unseen units; a unit's key has its leading space."""
        new = [u for u in units if u not in self.at]
        plain = [u for u in new if len(u) > 1 and u[0] == " " and not u[1:2].isspace() and not u[-1].isspace()]
        simple = set(plain)
        for i in range(0, len(plain), 4096):
            group = plain[i : i + 4096]
            ids = np.asarray(self.ranks.encode_to_numpy("".join(group)), dtype=np.uint32)
            firsts = np.flatnonzero(self.starts[ids])
            base = self.add(ids)
            sizes = np.diff(firsts, append=len(ids))
            self.at.update(zip(group, zip((firsts + base).tolist(), sizes.tolist(), strict=True), strict=True))
        for u in new:
            if u not in simple:
                ids = np.asarray(self.ranks.encode_ordinary(u), dtype=np.uint32)
                self.at[u] = (self.add(ids), len(ids))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without added tokens."""
        if len(self.at) > CACHE:
            self.forget()
        odd = pc.match_substring_regex(texts, f"{_SPACE} {_SPACE}|{_SPACE} $")
        for name in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, name))
        odd = odd.to_numpy(zero_copy_only=False)
        offsets, index, units = between_spaces(texts)
        firsts = [units[i] for i in index[offsets[:-1]]]
        units = [" " + u for u in units]
        # A unit that only odd texts have is learnt like any other; those texts are then done whole.
        self.learn(units)
        self.learn(firsts)
        at = np.array([self.at[u] for u in units], dtype=np.int64).reshape(-1, 2)[index]
        at[offsets[:-1]] = [self.at[u] for u in firsts]
        ends = np.cumsum(at[:, 1])
        ids = self.pool[np.repeat(at[:, 0] - (ends - at[:, 1]), at[:, 1]) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[offsets]
        out = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        rows = np.flatnonzero(odd)
        for r, whole_text in zip(rows, texts.take(pa.array(rows)).to_pylist(), strict=True):
            out[r] = np.array(self.library.encode(whole_text, add_special_tokens=False).ids, dtype=np.uint32)
        return out


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens: the first may be shorter, the rest are full."""
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


class _Groups:
    """Equal sequences in groups, by free space; each group knows which turns of which lengths it holds, and where."""

    def __init__(self, capacity: int):
        self.capacity, self.by_gap, self.gaps = capacity, {}, []

    def put(self, gap: int, count: int, held: list[tuple]) -> None:
        if count:
            if gap not in self.by_gap:
                self.by_gap[gap] = []
                insort(self.gaps, gap)
            self.by_gap[gap].append((count, held))

    def take(self, least: int, most: int):
        """The group of smallest free space of ``least`` to ``most``, or None."""
        k = bisect_left(self.gaps, least)
        if k == len(self.gaps) or self.gaps[k] > most:
            return None
        gap = self.gaps[k]
        found = self.by_gap[gap].pop()
        if not self.by_gap[gap]:
            del self.by_gap[gap], self.gaps[k]
        return gap, *found

    @staticmethod
    def part(held: list[tuple], skip: int) -> list[tuple]:
        """What the sequences of a group hold after the first ``skip`` of them."""
        return [(length, turn + skip * each, each, offset) for length, turn, each, offset in held]

    def fill(self, length: int, turn: int, left: int, most_each: int, new: bool) -> tuple[int, int]:
        """Put pieces of one length, from ``turn`` on, where the smallest gap stays. Returns the next turn and what is left."""
        while left:
            found = self.take(length, self.capacity)
            if found is None:
                if not new:
                    return turn, left
                found = (self.capacity, -(-left // min(most_each, self.capacity // length)), [])
            gap, count, held = found
            each = min(most_each, gap // length)
            full = min(count, left // each)
            self.put(gap - each * length, full, [*held, (length, turn, each, self.capacity - gap)])
            turn, left = turn + full * each, left - full * each
            if full < count:
                rest, later = self.part(held, full), left
                if later:
                    self.put(gap - later * length, 1, [*rest, (length, turn, later, self.capacity - gap)])
                    turn, left, rest, full = turn + later, 0, self.part(rest, 1), full + 1
                self.put(gap, count - full, rest)
        return turn, left


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Places for ``counts[length]`` pieces of each length: rows (length, from turn, to turn, sequence, each, offset).

    The piece of turn t goes to sequence ``sequence + (t - from) // each`` at ``offset + (t - from) % each * length``.
    At most two pieces of more than a third of a sequence are in one sequence.
    """
    left = {n: c for n, c in counts.items() if c}
    turn = dict.fromkeys(left, 0)
    groups = _Groups(capacity)
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if left[m] and n + m <= capacity and m <= n), None)
            if mate is None:
                groups.put(capacity - n, left[n], [(n, turn[n], 1, 0)])
                turn[n], left[n] = turn[n] + left[n], 0
            elif mate == n:
                if pairs := left[n] // 2:
                    groups.put(capacity - 2 * n, pairs, [(n, turn[n], 2, 0)])
                    turn[n], left[n] = turn[n] + 2 * pairs, left[n] - 2 * pairs
                if left[n]:
                    other = next((m for m in large if left[m] and m < n), None)
                    held = [(n, turn[n], 1, 0)]
                    turn[n], left[n] = turn[n] + 1, 0
                    if other is not None:
                        held.append((other, turn[other], 1, n))
                        turn[other], left[other] = turn[other] + 1, left[other] - 1
                    groups.put(capacity - sum(h[0] for h in held), 1, held)
            else:
                pairs = min(left[n], left[mate])
                groups.put(capacity - n - mate, pairs, [(n, turn[n], 1, 0), (mate, turn[mate], 1, n)])
                for m in (n, mate):
                    turn[m], left[m] = turn[m] + pairs, left[m] - pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        groups.fill(n, turn[n], left[n], capacity, new=True)
    rows, sequence = [], 0
    for gap in groups.gaps:
        for count, held in groups.by_gap[gap]:
            rows += [(length, first, first + count * each, sequence, each, offset) for length, first, each, offset in held]
            sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def tokenise(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int, tokenizer: str, ranks: str, keep_ids: bool) -> DataFrame:
    """A row for each piece of each document: id, piece, start, length, ids_crc32 (and ids), and its task and turn there."""

    def run(batches):
        encoder, part, turns = resident(f"packing {tokenizer} {ranks}", lambda: ByteBpe(tokenizer, ranks)), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for rows in slices(batches, 1):
            out = ([], [], [], [], [], [], [])
            for r, ids in enumerate(encoder.encode(texts_of(rows.column(1)))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                start = 0
                for k, n in enumerate(cut(len(ids), capacity)):
                    piece = ids[start : start + n]
                    for column, value in zip(out, (r, k, start, n, zlib.crc32(piece.tobytes()), turns[n], piece), strict=True):
                        column.append(value)
                    turns[n] += 1
                    start += n
            columns = [rows.column(0).take(pa.array(out[0])), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:5]), pa.array([part] * len(out[0]), pa.int64()), pa.array(out[5], pa.int64())]
            if keep_ids:
                columns.append(pa.array(out[6], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "part", "turn", "ids"][: len(columns)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, turn long" + ", ids array<long>" * keep_ids
    return docs.select(F.col(f"`{id_col}`").alias("id"), whole(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, ranks: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns a row for each piece: the id column, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``
    (and ``ids`` with ``keep_ids``). The ids of a sequence are those of its pieces in the order of ``offset``, without gaps.

    - A null text counts as empty; an empty text is a piece of the end token alone.
    - Only documents longer than ``capacity`` are cut.
    - Null and repeated ids are kept as they are: rows are packed, not ids.
    - An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = materialise(tokenise(docs, id_col, text_col, capacity, end_id, tokenizer, ranks, keep_ids), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(counts.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")
    # One number for each length: at most ``capacity`` rows, however many documents there are.
    total = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(total, capacity)
    key = places[:, 0] * (1 << 48) + places[:, 1]

    def run(batches):
        for rows in batches:
            length, turn = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            found = places[np.searchsorted(key, length * (1 << 48) + turn, side="right") - 1] if len(length) else places[:0]
            ahead = turn - found[:, 1]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(5)), pa.array(found[:, 3] + ahead // found[:, 4]), pa.array(found[:, 5] + ahead % found[:, 4] * length), *(rows.column(i) for i in range(6, rows.num_columns))], names=names)

    kind = pieces.schema["id"].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    placed = pieces.join(bases.select("part", "length", "base"), ["part", "length"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("turn") + F.col("base")).alias("turn"), *["ids"] * keep_ids)
    return placed.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<long>" * keep_ids)
