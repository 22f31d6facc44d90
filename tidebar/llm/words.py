"""Vectorised words, word hashes and sliding hashes over Arrow string batches.

Words are split at ASCII white space.  Everything works on slices of half a megabyte of text, so a task's memory
does not follow the batch; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD_MULT = np.uint64(0xD6E8FEB86659FD93)
_WORD_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows; null texts are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next slice up to a bound."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 2 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have[:n]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry at the end)."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    solid[1:-1] = ~_SPACE[data]
    begins = solid[1:-1] & ~solid[:-2]
    ends = solid[1:-1] & ~solid[2:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = solid[1:-1][cuts]
    ends[cuts - 1] = solid[1:-1][cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def _span_sums(values: np.ndarray, base: np.uint64, inverse: np.uint64, starts, ends) -> np.ndarray:
    """Polynomial hash of values[start:end] for each span."""
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=run[1:])
    return (run[ends] - run[starts]) * powers(inverse, len(values) + 1)[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; `lower` folds A-Z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    return mix(_span_sums(values, _MULT, _MULT_INV, starts, ends) + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive words of one sequence."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - n + 1)
    return mix(_span_sums(words, _WORD_MULT, _WORD_INV, at, at + n))


def sequence_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of words[start:end] for each span, its length included."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    return mix(_span_sums(words, _WORD_MULT, _WORD_INV, starts, ends) + (ends - starts).astype(np.uint64))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each `width` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's bigint."""
    return x.view(np.int64)


def byte_grams(data: np.ndarray, offsets: np.ndarray, order: int) -> np.ndarray:
    """For every byte, the `order` bytes before it in its text (zeros before the first) and itself, as one number."""
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    grams = data.astype(np.int64)
    for back in range(1, order + 1):
        before = np.zeros(len(data), np.int64)
        before[back:] = data[:-back] if back < len(data) else 0
        before[at < back] = 0
        grams |= before << (8 * back)
    return grams
