"""Words of Arrow text batches as hashes and byte places, without a Python object per word.

A word is a run of bytes other than space and 09-0D. Memory beyond the batch is bounded: byte-wise
work goes through slices of about 256 kB, and what stays is a few numbers per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BARE = LOWER.copy()
BARE[[b for b in range(33, 127) if not chr(b).isalnum()]] = 32
_SEED = np.random.default_rng(20_240_229)
_BYTE = _SEED.integers(0, 2**64, 256, np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (
    0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BASE = np.array([0x2545F4914F6CDD1D, 0xD1342543DE82EF95], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and where each text starts and ends; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def groups(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``limit`` bytes; a longer text stands alone."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of the first word of every text."""
    inside = ~SPACES[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1][at[:-1] < len(data)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit number per word: a sum of mixed (byte, place) pairs, mixed with the length."""
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    for i, j in groups(total):
        size = lengths[i:j]
        place = np.arange(total[i], total[j]) - np.repeat(total[i:j], size)
        value = _BYTE[data[np.repeat(starts[i:j], size) + place]] ^ (
            place.astype(np.uint64) * _M1)
        value *= _M2
        value ^= value >> np.uint64(29)
        value *= _M3
        out[i:j] = mix(np.add.reduceat(value, total[i:j] - total[i])
                       + size.astype(np.uint64) * _M1)
    return out


def texts(column: pa.Array, lower: bool = False, bare: bool = False) -> Iterator[tuple]:
    """Slices of whole texts: number of the first text, bytes, word starts and ends, first words,
    word hashes. ``lower`` maps A-Z only; ``bare`` also makes ASCII marks white space."""
    data, at = raw(column)
    for i, j in groups(at):
        part = data[at[i]: at[j]]
        part = BARE[part] if bare else LOWER[part] if lower else part
        starts, ends, first = places(part, at[i: j + 1] - at[i])
        yield i, part, starts, ends, first, hashes(part, starts, ends)


class Runs:
    """Hashes of any run of consecutive words in constant time, from prefix sums of powers."""

    def __init__(self, words: np.ndarray, lane: int = 0):
        words = words if lane == 0 else mix(words ^ _M1)
        def powers(base: int) -> np.ndarray:
            steps = np.full(len(words) + 1, base, np.uint64)
            steps[0] = 1
            return np.cumprod(steps, dtype=np.uint64)

        base = int(_BASE[lane])
        self.back = powers(pow(base, -1, 2**64))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(base)[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        size = np.broadcast_to(np.asarray(length, np.uint64), start.shape)
        return mix((self.sums[start + length] - self.sums[start]) * self.back[start] + size * _M3)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.ListArray:
    """An Arrow list column from flat values and the number of values per row."""
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
