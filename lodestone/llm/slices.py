"""Cutting Arrow batches of texts into slices of bounded size, and splitting those into pieces between spaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in order, in slices of about ``size`` bytes in column ``text``; no row is cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(at, end - at)
            at, done = end, int(ends[end - 1])


def texts_of(column: pa.Array) -> pa.Array:
    """A column as large strings in buffers of their own, null read as the empty text.

    The copy matters: some kernels misread what a cast makes of a slice.
    """
    own = column.take(pa.array(np.arange(len(column))))
    return pc.fill_null(own.cast(pa.large_string()), "")


def between_spaces(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Split texts at each U+0020: (offsets by text, index of each piece into the distinct pieces, distinct pieces)."""
    parts = pc.split_pattern(texts, " ")
    offsets = np.asarray(parts.offsets).astype(np.int64)
    flat = parts.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
    return offsets - offsets[0], flat.indices.to_numpy(zero_copy_only=False), flat.dictionary.to_pylist()


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between successive ``offsets``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
