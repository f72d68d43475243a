"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark texts, one scan of each text.

Both sides are normalised alike: A-Z in lower case, words joined by single spaces. The automaton holds each window once,
between spaces, so that it matches whole words only. Matches are mapped to words, and words to places in the text as given.

The automaton is broadcast, so its size is bounded: it holds about ``block_windows`` windows. A benchmark of ordinary size is
one block, and each text is scanned once. A larger one is cut into blocks, one after another on the driver and in a worker:
after each the table is written with what was found so far, and read again for the next.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import discard, fresh, materialise, resident, small_batches, whole
from lodestone.llm.slices import slices

#: The words, in a text whose A-Z are already in lower case.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Each byte that no word has (all of them ASCII) becomes a space; A-Z become a-z.
_TABLE = bytes((b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))


def normalise(text: str) -> str:
    """The words of a text between single spaces, each byte of their UTF-8 as one character."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def word_spans(text: str) -> list[tuple[int, int]]:
    """Places of the words in the text as given."""
    return [m.span() for m in re.finditer(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))]


def windows(text: str, size: int) -> list[str]:
    """All runs of ``size`` words of a benchmark text; all its words if it has fewer, none if it has no word."""
    words = normalise(text).split(" ")[1:-1]
    return [f" {' '.join(words[i : i + size])} " for i in range(max(1, len(words) - size + 1))] if words else []


def automaton(items: list[tuple], size: int):
    """(automaton, item ids by window number): the automaton gives a window's number, its length and its words."""
    import ahocorasick

    numbers: dict[str, int] = {}
    owners: list[set] = []
    for item, text in items:
        for w in windows(text or "", size):
            k = numbers.setdefault(w, len(numbers))
            if k == len(owners):
                owners.append(set())
            if item is not None:
                owners[k].add(item)
    found = ahocorasick.Automaton()
    for w, k in numbers.items():
        found.add_word(w, (k, len(w)))
    if numbers:
        found.make_automaton()
    return found, owners


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str, found, owners: list[set]) -> tuple[int, list[tuple[int, int]], set]:
    """(number of words, runs of hit words as [first, end), items with a window in the text)."""
    norm = normalise(text)
    if not norm:
        return 0, [], set()
    n_words, items, ends = norm.count(" ") - 1, set(), []
    if not owners:
        return n_words, [], items
    for end, (k, length) in found.iter(norm):
        ends.append((end - length + 1, end))
        items |= owners[k]
    runs = []
    if ends:
        spaces = np.flatnonzero(np.frombuffer(norm.encode("latin-1"), dtype=np.uint8) == 32)
        runs = joined(list(zip(*(np.searchsorted(spaces, e).tolist() for e in zip(*ends, strict=True)), strict=True)))
    return n_words, runs, items


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, columns: list[str] | None = None, block_windows: int = 500_000) -> DataFrame:
    """All rows of ``docs``, with all columns or those named, and with what the benchmark shares with each text.

    New columns: ``n_words``, ``n_hit``, ``n_items`` (long), ``items_sha256``, ``contaminated`` and ``hit_spans``, an array of
    (start, end) in characters of the text as given, one for each run of hit words.

    - A null text has no words; an empty one neither. A text without words is never contaminated.
    - Benchmark texts that are null or without words have no window; those without an id count for ``n_hit`` only.
    - Repeated rows and repeated items are taken as they are; equal windows of several items count for each of them.
    - An empty benchmark hits nothing; an empty table gives an empty result.
    - Columns of ``docs`` named like a new one are replaced by it.
    """
    new = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "items_sha256": T.StringType(), "contaminated": T.BooleanType(), "hit_spans": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))}
    named = [c for c in (docs.columns if columns is None else columns) if c not in new]
    text, runs, items = (fresh(docs, n) for n in ("whole_text", "hit_runs", "hit_items"))
    n = len(named)
    out = docs.select(*[F.col(f"`{c}`") for c in named], whole(text_col).alias(text))
    small_batches(docs.sparkSession)
    blocks, n_blocks = _blocks(benchmark.select(F.col(f"`{item_col}`").alias("item"), whole(item_text_col).alias("text")), size, block_windows)
    for k in range(n_blocks - 1):
        earlier = out
        out = materialise(_scanned(out, n, blocks(k), size, T.StructType([*out.schema.fields[: n + 1], T.StructField(runs, T.ArrayType(T.LongType())), T.StructField(items, T.ArrayType(T.StringType()))]), False), "scanned")
        if k:
            discard(earlier)
    return _scanned(out, n, blocks(n_blocks - 1), size, T.StructType([*out.schema.fields[:n], *(T.StructField(k, v) for k, v in new.items())]), True)


def _scanned(rows: DataFrame, n: int, items: list[tuple], size: int, schema: T.StructType, last: bool) -> DataFrame:
    """Scan the texts (column ``n``) with the automaton of ``items``; columns after it have what earlier blocks found."""
    sent, name = rows.sparkSession.sparkContext.broadcast(items), f"windows {uuid.uuid4().hex}"
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), spans_type) if last else (pa.list_(pa.int64()), pa.list_(pa.string()))

    def run(batches):
        found, owners = resident(name, lambda: automaton(sent.value, size))
        for part in slices(batches, n):
            known = [c.to_pylist() for c in part.columns[n + 1 :]] or [[()] * part.num_rows] * 2
            made = tuple([] for _ in kinds)
            for t, more, names in zip(part.column(n).to_pylist(), *known, strict=True):
                n_words, runs, own = scan(t, found, owners)
                runs = joined([*runs, *zip(more[::2], more[1::2], strict=True)])
                own = sorted({*map(str, own), *names})
                values = [x for r in runs for x in r], own
                if last:
                    hit = sum(b - a for a, b in runs)
                    places = word_spans(t) if runs else []
                    spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs]
                    values = n_words, hit, len(own), hashlib.sha256(",".join(own).encode()).hexdigest(), hit > 0, spans
                for column, value in zip(made, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*part.columns[: n if last else n + 1], *(pa.array(c, k) for c, k in zip(made, kinds, strict=True))], names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _blocks(items: DataFrame, size: int, most: int):
    """The benchmark in blocks of about ``most`` windows: (block by number, as a list on the driver; how many there are).

    Windows are counted as they are taken, from the words. An item of more than ``most`` of them is cut into pieces that share
    ``size`` - 1 words, so each window is in one piece.
    """
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = items.select("item", F.regexp_extract_all(low, F.lit(WORD), 0).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0)), F.lit(most))
    pieces = words.select("item", "words", F.explode(starts).alias("start")).select("item", "start", F.slice("words", F.col("start") + 1, F.lit(most + size - 1)).alias("words"))
    counted = pieces.select("item", "start", F.greatest(F.size("words") - size + 1, F.lit(1)).alias("n"), F.array_join("words", " ").alias("text"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    n_blocks = max(1, -(-total // most))
    block = F.pmod(F.xxhash64("item", "start", "text"), F.lit(n_blocks))
    return lambda k: [(r["item"], r["text"]) for r in counted.where(block == k).select("item", "text").collect()], n_blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with its columns; see ``find_contamination``."""
    safe = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index(options.pop('text_col', 'text'))}"
    marked = find_contamination(safe, benchmark, text_col=text, **options).where("contaminated = false")
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
