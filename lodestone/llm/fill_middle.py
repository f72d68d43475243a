"""Fill-in-the-middle transformation by displacement scatter.

A batch of texts is one array of UTF-8 bytes. The cuts of all its documents are found in one scan of the bytes that start a code
point. A document's output is its three parts in another order between markers, so all bytes of a part move by the same
distance. These distances go into a difference array at the byte where a part starts; its running sum is the shift of every byte,
and one scatter writes all outputs. The inverse finds the markers in the outputs, builds the shifts back in the same way, and
gathers the texts from there.

A text that holds a marker stays plain, so in an output that is not plain the first three markers found are those written, and
the text comes back exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import fresh, small_batches, whole
from lodestone.llm.slices import slices, texts_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKER = 3  # bytes of each
#: Bytes whose shifts are worked out at once: what a long text needs besides its bytes is bounded by this.
SPAN = 1 << 20
BLOCK = 4096

PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large strings without nulls and where each starts (with the end of the last)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    data = texts.buffers()[2]
    all_bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Large strings from their bytes; handed on as usual strings where they fit."""
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data))
    return made.cast(pa.string()) if len(data) < 2**31 - 1 else made


class _Starts:
    """Where code points start in bytes, counted by blocks."""

    def __init__(self, data: np.ndarray):
        self.is_start = (data & 0xC0) != 0x80
        at = np.arange(0, len(data), BLOCK)
        self.before = np.concatenate([[0], np.cumsum(np.add.reduceat(self.is_start, at, dtype=np.int64))]) if len(data) else np.zeros(1, np.int64)

    def upto(self, byte: np.ndarray) -> np.ndarray:
        """How many code points start before each byte position."""
        block = byte // BLOCK
        return self.before[block] + np.fromiter((np.count_nonzero(self.is_start[b * BLOCK : p]) for b, p in zip(block.tolist(), byte.tolist(), strict=True)), np.int64, len(byte))

    def byte_of(self, point: np.ndarray) -> np.ndarray:
        """The byte at which each code point (counted from 0) starts; the end where there are no more."""
        block = np.searchsorted(self.before, point, side="right") - 1
        found = np.full(len(point), len(self.is_start), np.int64)
        for k in np.flatnonzero(point < self.before[-1]):
            b = int(block[k]) * BLOCK
            found[k] = b + np.flatnonzero(self.is_start[b : b + BLOCK])[point[k] - self.before[block[k]]]
        return found


def markers(data: np.ndarray) -> np.ndarray:
    """Positions at which a marker starts."""
    if len(data) < MARKER:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[:-2] == PREFIX[0])
    kind = data[at + 1]
    return at[((kind == PREFIX[1]) | (kind == SUFFIX[1]) | (kind == MIDDLE[1])) & (data[at + 2] == PREFIX[2])]


def displacements(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, shift of each byte between) in spans, from the bytes where parts start (ascending, ties by the last) and their shifts."""
    steps = np.diff(shifts, prepend=0)
    carry = 0
    for a in range(0, size, SPAN):
        b = min(a + SPAN, size)
        low, high = np.searchsorted(starts, [a, b])
        change = np.zeros(b - a, np.int64)
        np.add.at(change, starts[low:high] - a, steps[low:high])
        change[0] += carry
        shift = np.cumsum(change)
        carry = int(shift[-1])
        yield a, b, shift


def scatter(texts: pa.Array, draws: list[np.ndarray], plain_share: int = 10, spm_share: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(code points, form, code points of the prefix, of the middle, outputs) of texts, from four draws for each."""
    data, offsets = _buffers(texts)
    starts = _Starts(data)
    first = starts.upto(offsets)
    n = np.diff(first)
    marked = np.zeros(len(n), bool)
    found = markers(data)
    owner = np.searchsorted(offsets, found, side="right") - 1
    marked[owner[found + MARKER <= offsets[owner + 1]]] = True
    h1, h2, h3, h4 = draws
    form = np.where((n == 0) | marked | (h3 % 100 >= 100 - plain_share), PLAIN, np.where(h4 % 100 < spm_share, SPM, PSM))
    c1, c2 = h1 % (n + 1), h2 % (n + 1)
    low, high = np.minimum(c1, c2), np.maximum(c1, c2)
    # A cut at the end of a text is the first byte of the next one, or the end of all.
    cut1, cut2 = starts.byte_of(first[:-1] + low), starts.byte_of(first[:-1] + high)
    begin, end = offsets[:-1], offsets[1:]
    moved = form != PLAIN
    out_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) + 3 * MARKER * moved)])
    to = out_offsets[:-1]
    p, s = cut1 - begin, end - cut2
    spm = form == SPM
    # Where each part begins in the output.
    at_p = to + np.where(moved, np.where(spm, 2 * MARKER + s, MARKER), 0)
    at_s = np.where(moved, to + np.where(spm, MARKER, 2 * MARKER + p), at_p + (cut2 - begin))
    at_m = np.where(moved, to + 3 * MARKER + p + s, at_p + p)
    parts = np.stack([begin, cut1, cut2], axis=1).ravel()
    shifts = np.stack([at_p - begin, at_m - cut1, at_s - cut2], axis=1).ravel()
    out = np.empty(int(out_offsets[-1]), np.uint8)
    for a, b, shift in displacements(parts, shifts, len(data)):
        shift += np.arange(a, b)
        out[shift] = data[a:b]
    for name, at in ((PREFIX, at_p), (SUFFIX, at_s), (MIDDLE, at_m)):
        for k, byte in enumerate(name):
            out[at[moved] - MARKER + k] = byte
    return n, form, low, high - low, _strings(out, out_offsets)


def gather(outputs: pa.Array, form: np.ndarray) -> pa.Array:
    """The texts from their outputs and forms alone."""
    data, offsets = _buffers(outputs)
    begin, end = offsets[:-1], offsets[1:]
    moved = form != PLAIN
    found = markers(data)
    owner = np.searchsorted(offsets, found, side="right") - 1
    found = found[moved[owner] & (found + MARKER <= offsets[owner + 1])].reshape(-1, 3)
    if len(found) != np.count_nonzero(moved):
        raise ValueError("an output that is not plain must hold three markers")
    spm = form[moved] == SPM
    after = found + MARKER
    m0, s_len, p_len = after[:, 2], np.where(spm, found[:, 1] - after[:, 0], found[:, 2] - after[:, 1]), np.where(spm, found[:, 2] - after[:, 1], found[:, 1] - after[:, 0])
    p0, s0 = np.where(spm, after[:, 1], after[:, 0]), np.where(spm, after[:, 0], after[:, 1])
    out_offsets = np.concatenate([[0], np.cumsum(np.diff(offsets) - 3 * MARKER * moved)])
    to = out_offsets[:-1]
    # A plain text is one part that starts where it did.
    lead, mid, tail = to.copy(), to.copy(), to.copy()
    from_lead, from_mid, from_tail = begin.copy(), begin.copy(), begin.copy()
    mid[moved] = to[moved] + p_len
    tail[moved] = out_offsets[1:][moved] - s_len
    from_lead[moved], from_mid[moved], from_tail[moved] = p0, m0, s0
    starts = np.stack([lead, mid, tail], axis=1).ravel()
    shifts = np.stack([from_lead - lead, from_mid - mid, from_tail - tail], axis=1).ravel()
    back = np.empty(int(out_offsets[-1]), np.uint8)
    for a, b, shift in displacements(starts, shifts, len(back)):
        shift += np.arange(a, b)
        back[a:b] = data[shift]
    return _strings(back, out_offsets)


def draws(id_col: str, seed: str = "1") -> list[Column]:
    """Four numbers below 2^32 from an id: the first groups of the SHA-256 of the seed and the id; a null id reads as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, seed: str = "1", plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """All rows of ``docs``, with all columns or those named, with ``n`` (code points), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    Two cuts are drawn from the id; ``plain_share`` of a hundred texts stay plain, of the others ``spm_share`` of a hundred
    have their suffix first. Whole texts are cut between code points; no row is shuffled.

    - A null text counts as the empty text; the empty text is plain. A text that holds a marker is plain.
    - Plain rows have null for ``prefix_chars`` and ``middle_chars``, and the text itself as ``output``.
    - Rows with the same id are cut by the same draws; a null id draws as the empty string.
    - Very long texts are one slice each; beside its bytes and a byte for each of them, memory is bounded by ``SPAN``.
    - Repeated rows each get their output; an empty table gives an empty result.
    - Columns of ``docs`` named like a new one are replaced by it.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    named = [c for c in (docs.columns if columns is None else columns) if c not in new]
    inner = [fresh(docs, n) for n in ("whole_text", "draw1", "draw2", "draw3", "draw4")]
    rows = docs.select(*[F.col(f"`{c}`") for c in named], *[c.alias(n) for c, n in zip([whole(text_col), *draws(id_col, seed)], inner, strict=True)])
    small_batches(docs.sparkSession)
    k = len(named)

    def run(batches):
        for part in slices(batches, k):
            hs = [part.column(k + i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            n, form, prefix, middle, output = scatter(texts_of(part.column(k)), hs, plain_share, spm_share)
            plain = form == PLAIN
            forms = pa.DictionaryArray.from_arrays(pa.array(form, pa.int8()), pa.array(FORMS)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(n, pa.int64()), forms, pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), output], names=[*part.schema.names[:k], *new])

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:k], *(T.StructField(c, t) for c, t in zip(new, kinds, strict=True))]))


def restore(made: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``made`` with the text that each output and its form came from, as column ``name``.

    A null output or form is read as an empty plain text. An output that is not plain and lacks its three markers is an error.
    """
    named = [c for c in made.columns if c != name]
    out, form = fresh(made, "own_output"), fresh(made, "own_form")
    code = F.when(F.col(f"`{form_col}`") == "psm", PSM).when(F.col(f"`{form_col}`") == "spm", SPM).otherwise(PLAIN).cast("int")
    rows = made.select(*[F.col(f"`{c}`") for c in named], whole(output_col).alias(out), code.alias(form))
    small_batches(made.sparkSession)
    k = len(named)

    def run(batches):
        for part in slices(batches, k):
            back = gather(texts_of(part.column(k)), part.column(k + 1).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*part.columns[:k], back], names=[*part.schema.names[:k], name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:k], T.StructField(name, T.StringType())]))
