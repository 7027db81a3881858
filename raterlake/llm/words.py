"""Words of Arrow string columns as codes into the distinct words of a block of texts, so that what depends on a word alone is done once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from raterlake.llm import text

#: Bytes that belong to words: of runs without ASCII white space, and of digits, small letters and all that isn't ASCII.
NO_SPACE = np.ones(256, bool)
NO_SPACE[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Coded:
    """codes: the place of each word in ``distinct`` (binary, UTF-8); first: the first word of each text (one more at the end)."""

    codes: np.ndarray
    distinct: pa.Array
    first: np.ndarray


def coded(column: pa.Array, member: np.ndarray, lower: bool = False, kinds: np.ndarray | None = None) -> Coded:
    """Words of a large string array without nulls: the longest runs of bytes in ``member``, a table over bytes that must hold all bytes
    from 128 or none. lower: A-Z count as a-z. kinds: a table over bytes; words are cut between bytes of different kinds over 0, and between
    two of kind 1."""
    data, offsets = text.utf8(column)
    data = _LOWER[data] if lower else data
    inside = member[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    if kinds is not None:
        kind = kinds[data]
        begins[1:] |= (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 1)) & inside[1:]
    start = np.flatnonzero(begins)
    # Without the bytes between, a word ends where the next begins.
    place = np.cumsum(inside)
    bounds = np.append(place[start] - 1, place[-1] if len(data) else 0).astype(np.int64)
    raw = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    encoded = raw.dictionary_encode()
    return Coded(encoded.indices.to_numpy(), encoded.dictionary, np.searchsorted(start, offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places starts[k], starts[k] + 1, ... of lengths[k] many, for all k one after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(int(total[-1]) if len(total) else 0)
