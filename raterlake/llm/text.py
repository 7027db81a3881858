"""Vectorised words, word hashes and shingles of Arrow string columns.

Words are maximal runs of characters other than ASCII white space (space, tab to carriage return).
White-space bytes never occur inside a multi-byte UTF-8 character, so the work is done on bytes:
one pass finds the words of a whole batch, and a prefix sum of a polynomial gives each word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.random.default_rng(20_240_101).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_STEPS = np.random.default_rng(20_240_102).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text worked on at a time; one longer document makes a block of its own.
BLOCK = 1 << 20


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n + n // 4, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijective scrambling of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of some texts: hashes, byte places in data, and the first word of each text (one more at the end)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def of(self, k: int) -> slice:
        return slice(int(self.first[k]), int(self.first[k + 1]))


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large string array with empty strings for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins (one more at the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def _starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte belongs to a word, and whether it begins one."""
    is_word = _WORD[data]
    inside = offsets[:-1][offsets[:-1] < len(data)]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    starts[inside] = is_word[inside]
    return is_word, starts


def counts(column: pa.Array) -> np.ndarray:
    """The number of words of each text."""
    data, offsets = utf8(column)
    return np.diff(np.searchsorted(np.flatnonzero(_starts(data, offsets)[1]), offsets))


def words(column: pa.Array, lower: bool = True, keep: np.ndarray | None = None) -> Words:
    """Words of a large string array without nulls. keep: a table of bytes that count; others are skipped inside words."""
    data, offsets = utf8(column)
    is_word, starts = _starts(data, offsets)
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = is_word[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    powers, inverse = _power(len(data) + 1)
    values = _BYTES[_LOWER[data]] if lower else _BYTES[data]
    if keep is not None:
        used = keep[data]
        # A skipped byte takes no power of its own, so that words with and without it hash alike.
        place = np.cumsum(used)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(np.where(used, values * powers[place - used], np.uint64(0)), dtype=np.uint64)))
        shift = np.concatenate((place - used, place[-1:]))[start] if len(data) else start
        return Words(data, offsets, start, end, first, mix((sums[end] - sums[start]) * inverse[shift]))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers[: len(data)], dtype=np.uint64, out=sums[1:])
    return Words(data, offsets, start, end, first, mix((sums[end] - sums[start]) * inverse[start]))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k neighbouring values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _STEPS[0]
    for j in range(1, k):
        total += hashes[j : j + n] * _STEPS[j]
    return mix(total)


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word runs of one text in order; of the whole text if it has fewer words; none without words."""
    if len(hashes) >= k or not len(hashes):
        return runs(hashes, k)
    return runs(hashes, len(hashes)) ^ np.uint64(len(hashes))


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(shingles(hashes, k))
