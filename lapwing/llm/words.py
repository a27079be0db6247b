"""Words of whole Arrow columns as 64-bit hashes, computed on the column's bytes.

A word is a run of bytes other than the six ASCII white-space bytes; A-Z count as a-z.  A hash depends on the word
alone, so every task and every job gives a word the same number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# A piece of a column that is hashed at once: its arrays stay within a processor's cache.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finaliser: spreads every bit of a number over the whole of it."""
    x = np.asarray(x, dtype=_U).copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeded(seed: int, count: int) -> np.ndarray:
    """``count`` fixed pseudo-random numbers."""
    return mix((np.arange(1, count + 1, dtype=_U) + _U(seed << 20)) * _U(_BASE))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = seeded(1, 256)
_BYTE[65:91] = _BYTE[97:123]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for ``n`` positions at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        both = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, factor, dtype=_U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers


@dataclass
class Words:
    """Words of a column: hashes, byte places in ``data``, and where each row's words begin (rows + 1 entries)."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    data: np.ndarray

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words inside a row, and where each row's runs begin."""
        n = np.diff(self.rows)
        runs = np.maximum(n - (k - 1), 0)
        begin = np.concatenate(([0], np.cumsum(runs)))
        if not begin[-1]:
            return np.empty(0, dtype=_U), begin
        total = len(self.hashes) - k + 1
        h = np.zeros(total, dtype=_U)
        for j, factor in enumerate(seeded(2, k) | _U(1)):
            h += self.hashes[j : j + total] * factor
        if begin[-1] != total:
            first = np.repeat(self.rows[:-1] - begin[:-1], runs) + np.arange(begin[-1])
            h = h[first]
        return mix(h), begin


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    where = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, dtype=np.uint8)
    return raw[where[0] : where[-1]], where - where[0]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(data):
        hi = lo + PIECE
        if hi >= len(data):
            yield lo, len(data)
            return
        row = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
        if row > lo:
            hi = row
        else:  # one long row: cut it at white space, or after it if it has none
            end = int(offsets[np.searchsorted(offsets, lo, side="right")])
            gaps = np.flatnonzero(_SPACE[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:
                while hi < end and not _SPACE[data[hi]]:
                    hi += 1
        yield lo, hi
        lo = hi


def split(column: pa.Array) -> Words:
    data, offsets = column_bytes(column)
    hashes, starts, ends = [], [], []
    for lo, hi in _pieces(data, offsets):
        b = data[lo:hi]
        solid = ~_SPACE[b]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        edge = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi)] - lo
        first[edge] = solid[edge]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | first[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _power_tables(len(b) + 1)
        total = np.zeros(len(b) + 1, dtype=_U)
        np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
        starts.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        empty = np.empty(0, dtype=np.int64)
        return Words(np.empty(0, dtype=_U), empty, empty, np.zeros(len(offsets), dtype=np.int64), data)
    begin = np.concatenate(starts)
    return Words(np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets), data)


def distinct_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and where each row's values begin."""
    v = values.copy()
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist()):
        v[lo:hi].sort()
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = v[1:] != v[:-1]
    keep[rows[:-1][rows[:-1] < rows[1:]]] = True
    return v[keep], np.concatenate(([0], np.cumsum(keep)))[rows]


def long_lists(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    """A column of ``array<bigint>``."""
    return pa.ListArray.from_arrays(pa.array(begin, type=pa.int32()), pa.array(values.astype(np.int64), type=pa.int64()))
