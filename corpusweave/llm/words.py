"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

A word is a run of bytes other than the six of ``[\\x20\\x09-\\x0D]``. Words are told apart by a
64-bit hash of their bytes. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 512 << 10

# Odd multipliers and the constants of a 64-bit finalizer (public domain, MurmurHash3).
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_SHIFT = np.uint64(33)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on every bit; writes over its input."""
    values ^= values >> _SHIFT
    values *= _MIX[0]
    values ^= values >> _SHIFT
    values *= _MIX[1]
    values ^= values >> _SHIFT
    return values


@lru_cache(maxsize=4)
def _power_table(base: int, size: int) -> np.ndarray:
    known = np.ones(1, dtype=np.uint64)
    while len(known) < size:
        step = np.uint64(pow(base, len(known), 1 << 64))
        known = np.concatenate([known, known * step])
    return known


def _power(base: int, count: int) -> np.ndarray:
    """``base ** 0, base ** 1, …`` modulo 2 ** 64.

    The tables are kept by a cached function, since functions sent to tasks take module variables along.
    """
    return _power_table(base, 1 << max(count, SLICE_BYTES + 1).bit_length())[:count]


@dataclass
class Words:
    """The words of some texts, in order. ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # of each text in ``data``
    start: np.ndarray  # of each word in ``data``
    end: np.ndarray
    first: np.ndarray  # of each text in ``start``

    def hashes(self, lower: bool = False, table: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` takes A-Z as a-z."""
        if table is None:
            table = _LOWER if lower else np.arange(256, dtype=np.uint8)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((table[self.data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(self.data)), out=total[1:])
        value = total[self.end] - total[self.start]
        value *= _power(_INVERSE, len(self.data) + 1)[self.start]
        value += (self.end - self.start).astype(np.uint64) << np.uint64(56)
        return mix(value)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> Words:
    gap = np.ones(len(data) + 1, dtype=bool)
    gap[:-1] = separator[data]
    before = np.empty(len(data) + 1, dtype=bool)
    before[0] = True
    before[1:] = gap[:-1]
    before[offsets] = True  # a text begins anew, whatever stands before
    start = np.flatnonzero(~gap & before)
    after = np.empty(len(data), dtype=bool)
    after[:] = gap[1:]
    inner = offsets[(offsets > 0) & (offsets <= len(data))]
    after[inner - 1] = True
    end = np.flatnonzero(~gap[:-1] & after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: rows, bytes, offsets."""
    data, offsets = string_parts(column)
    row = 0
    while row < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        to = min(max(to, row + 1), len(offsets) - 1)
        yield slice(row, to), data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row]
        row = to


def windows(words: Words, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word and a hash of each run of ``width`` words that lies in one text."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    for at in range(width):
        total += hashes[at : at + count] * np.uint64(pow(_BASE, at + 1, 1 << 64))
    inside = np.ones(count, dtype=bool)
    last = words.first[1:-1]
    for at in range(1, width):  # a run that a text begins within
        cut = last - at
        inside[cut[(cut >= 0) & (cut < count)]] = False
    first = np.flatnonzero(inside)
    return first, mix(total[first])


def word_column(words: Words) -> pa.Array:
    """The words as bytes at every second place of an Arrow column, from the first; between them what parts them."""
    bounds = np.empty(2 * len(words.start), dtype=np.int64)
    bounds[0::2], bounds[1::2] = words.start, words.end
    if not len(bounds):
        return pa.array([], pa.large_binary())
    parts = [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(words.data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, parts)


def ramps(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, …``, ``count[i]`` of them, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)
