"""Arrow batches in small slices, so that a worker never holds a whole batch of texts as Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a slice, and bytes beyond which a slice is cut further.
ROWS, BYTES = 256, 4 << 20


def slices(batches, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, ``rows`` at a time or fewer where they are large; one row at least."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, rows)
            while some.num_rows > 1 and some.nbytes > most:
                some = some.slice(0, max(1, some.num_rows // 2))
            at += some.num_rows
            yield some
    pa.default_memory_pool().release_unused()


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, cuts) of a string or binary column without nulls: row k is data[cuts[k]:cuts[k + 1]]; no copy of the data."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, cuts, data = column.buffers()
    cuts = np.frombuffer(cuts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[cuts[0] : cuts[-1]], cuts - cuts[0]


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes of the ranges (both ends included)."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


def word_spans(data: np.ndarray, cuts: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, stops, first) of all words of the rows, maximal runs of bytes of ``in_word`` inside a row.

    Row k has the words first[k] to first[k + 1].
    """
    held = np.zeros(len(data) + 1, bool)
    held[:-1] = in_word[data]
    opens = held.copy()
    opens[1:] &= ~held[:-1]
    edge = cuts[:-1][cuts[:-1] < len(data)]
    opens[edge] = held[edge]
    closes = np.zeros(len(data) + 1, bool)
    closes[1:] = held[:-1] & (~held[1:] | opens[1:])
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes), np.searchsorted(starts, cuts)
