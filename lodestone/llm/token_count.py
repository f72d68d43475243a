"""Token counts by a piece model, with a whole-token shortcut.

The library's counts are needed for every whole text, but most of a text is made of pre-tokens (a space mark and what
follows up to the next) that the vocabulary holds whole. Offline, on the driver, each vocabulary string that starts with
the space mark is encoded alone; those that come back as one token form the proven set. In a task a text is split at its
spaces; pre-tokens of the proven set count one, the distinct rest go through the library's merges, once for each task's
cache, and the counts are summed by text.

Splitting is exact because no entry of the vocabulary has a space mark after another character (``proven`` checks it), so
no merge can cross a split. Texts with space runs, leading or trailing spaces or a literal space mark go to the library
whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, resident, small_batches, whole
from lodestone.llm.slices import between_spaces, slices, sums, texts_of

MARK = "▁"
#: Distinct pre-tokens that a worker keeps the counts of (about 150 bytes each); then it starts anew.
CACHE = 300_000


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def proven(path: str) -> frozenset[str]:
    """Pre-tokens (without their space mark) that the library encodes alone as the one token of that name.

    Fails if the vocabulary could merge across pre-tokens, or the model rewrites texts, as the shortcut would then be wrong.
    """
    sp = _model(path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    normal = [(i, n) for i, n in enumerate(names) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    if any(MARK in n.lstrip(MARK) for _, n in normal) or any(re.match(f"{MARK}{MARK}+[^{MARK}]", n) for _, n in normal):
        raise ValueError(f"{path}: tokens can cross a space; count whole texts instead")
    if sp.encode("Ａ ①\n", out_type=str)[0][0] != MARK or sp.decode(sp.encode("Ａ  ①\n")) != "Ａ  ①\n":
        raise ValueError(f"{path}: the model rewrites texts; count whole texts instead")
    alone = [(i, n[1:]) for i, n in normal if n[0] == MARK and n.count(MARK) == 1 and len(n) > 1]
    return frozenset(n for (i, n), ids in zip(alone, sp.encode([n for _, n in alone], num_threads=1), strict=True) if ids == [i])


class _Counter:
    """Token counts of pre-tokens in one worker."""

    def __init__(self, path: str, whole_tokens: frozenset[str]):
        self.sp, self.whole_tokens, self.known = _model(path), whole_tokens, {}
        self.starts = np.array([self.sp.id_to_piece(i).startswith(MARK) for i in range(self.sp.get_piece_size())])

    def merge(self, units: list[str]) -> None:
        """Encode unseen pre-tokens, many in one call; each token with a space mark starts the next pre-token."""
        groups = [units[i : i + 64] for i in range(0, len(units), 64)]
        for group, ids in zip(groups, self.sp.encode([" ".join(g) for g in groups], num_threads=1), strict=True):
            firsts = np.flatnonzero(self.starts[ids])
            self.known.update(zip(group, np.diff(firsts, append=len(ids)).tolist(), strict=True))

    def counts(self, units: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known = {}
        known, one = self.known, self.whole_tokens
        # Only texts that are counted whole have empty pre-tokens or literal marks.
        self.merge([u for u in units if u and u not in one and u not in known and MARK not in u])
        return np.fromiter((1 if u in one else known.get(u, 0) for u in units), dtype=np.int64, count=len(units))

    def texts(self, texts: pa.Array) -> np.ndarray:
        odd = pc.or_(pc.match_substring_regex(texts, "^ |  | $|" + MARK), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        offsets, index, units = between_spaces(texts)
        total = sums(self.counts(units)[index], offsets)
        rows = np.flatnonzero(odd)
        total[rows] = [len(ids) for ids in self.sp.encode(texts.take(pa.array(rows)).to_pylist(), num_threads=1)]
        return total


def count_tokens(docs: DataFrame, text_col: str = "text", model: str | None = None, limit: int = 4096, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, with all columns or those named, and with ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (``n_tokens`` > ``limit``).

    Counts are those of the library for the whole text, without begin, end or added special tokens; the names of special
    tokens inside a text are ordinary characters, as by the library's default. No row is shuffled.

    - A null or empty text has 0 bytes and 0 tokens.
    - Very long texts are one slice each; memory follows the longest text of a batch.
    - Repeated rows each get their count; an empty table gives an empty result.
    - Columns of ``docs`` named like a new one are replaced by it.
    """
    inner = fresh(docs, "whole_text")
    named = [c for c in (docs.columns if columns is None else columns) if c not in ("n_bytes", "n_tokens", "over_limit")]
    docs = docs.select(*[F.col(f"`{c}`") for c in named], whole(text_col).alias(inner))
    small_batches(docs.sparkSession)
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    one = proven(path)
    n_cols = len(named)

    def run(batches):
        counter = resident(f"token counts {path}", lambda: _Counter(path, one))
        for part in slices(batches, n_cols):
            texts = texts_of(part.column(n_cols))
            n = counter.texts(texts)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:n_cols], pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[*part.schema.names[:n_cols], "n_bytes", "n_tokens", "over_limit"],
            )

    schema = T.StructType([*docs.schema.fields[:n_cols], *(T.StructField(n, k) for n, k in (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())))])
    return docs.mapInArrow(run, schema)
