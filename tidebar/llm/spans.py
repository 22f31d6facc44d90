"""Words between separator bytes, over Arrow string batches, with long texts cut into fragments.

A fragment ends at a separator, so no word is cut, and holds about half a megabyte at most unless one word is longer.
What a caller gathers over the fragments of a text is its own affair; nothing here grows with a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

FRAGMENT_BYTES = 1 << 19


class Words(NamedTuple):
    """Words of consecutive rows (or of one fragment of one row)."""
    first: int             # row of the batch that the slice begins with
    data: np.ndarray       # bytes
    starts: np.ndarray     # of each word
    ends: np.ndarray
    rows: np.ndarray       # row of the batch of each word
    begins: bool           # whether the slice begins with the first byte of its first row
    last: int              # the row it ends in
    ended: bool            # whether it ends with that row's last byte


def byte_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_string())
    bufs, n = texts.buffers(), len(texts)
    offsets = np.frombuffer(bufs[1], np.int64)[texts.offset:texts.offset + n + 1]
    return np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8), offsets


def _fragment_end(data: np.ndarray, start: int, stop: int, table: np.ndarray, most: int) -> int:
    """The last separator's end within `most` bytes, or else the next separator's end, or else `stop`."""
    if stop - start <= most:
        return stop
    back = np.flatnonzero(table[data[start:start + most]])
    if len(back):
        return start + int(back[-1]) + 1
    at = start + most
    while at < stop:
        found = np.flatnonzero(table[data[at:at + most]])
        if len(found):
            return min(stop, at + int(found[0]) + 1)
        at += most
    return stop


def word_slices(texts: pa.Array, table: np.ndarray, most: int = FRAGMENT_BYTES) -> Iterator[Words]:
    """Slices of all rows in order; null texts are empty, every row ends in exactly one slice."""
    n = len(texts)
    if not n:
        return
    data, offsets = _buffers(texts)
    row = 0
    while row < n:
        end = min(n, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        if end > row:
            yield _words(data, offsets[row:end + 1], row, table, True, True)
            row = end
            continue
        start, stop = int(offsets[row]), int(offsets[row + 1])
        at = start
        while True:
            cut = _fragment_end(data, at, stop, table, most)
            yield _words(data, np.array([at, cut]), row, table, at == start, cut == stop)
            if cut == stop:
                break
            at = cut
        row += 1


def _words(data, offsets, first, table, begins, ended) -> Words:
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~table[data]
    starts_here = solid[1:-1] & ~solid[:-2]
    ends_here = solid[1:-1] & ~solid[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts_here[cuts] = solid[1:-1][cuts]
    ends_here[cuts - 1] = solid[1:-1][cuts - 1]
    starts = np.flatnonzero(starts_here)
    rows = first + np.searchsorted(offsets[1:], starts, "right")
    return Words(first, data, starts, np.flatnonzero(ends_here) + 1, rows, begins, first + len(offsets) - 2, ended)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as one Arrow array, without a Python object per word."""
    sizes = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1                        # a word may begin where another ends: both sum to a change of nothing
    kept = data[np.cumsum(inside[:-1]).astype(bool)]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists number `picks` of many lists inside `values`, end to end, and the size of each."""
    sizes = sizes[picks]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts[picks] - (ends - sizes), sizes)], sizes
