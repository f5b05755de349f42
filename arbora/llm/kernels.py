"""Vectorised word kernels over Arrow string columns.

Words are maximal runs of bytes outside space and 0x09-0x0D.  All of UTF-8's other bytes are 0x80 or more, so the byte
view and the code point view agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of the kernels takes, unless a single text is longer.
CHUNK_BYTES = 500_000
#: Texts that one pass takes at most.
CHUNK_ROWS = 4096

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_MUL = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
BASE_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


_POW = powers(BASE, 4096)


def power_of(p: np.ndarray) -> np.ndarray:
    """BASE**p; the table covers usual words, and longer ones are computed."""
    global _POW
    if len(p) and (m := int(p.max())) >= len(_POW):
        return powers(BASE, m + 1)[p]
    return _POW[p]


class Words:
    """The words of some texts: ``n`` per text, ``first`` index per text, byte ``start``/``end`` and a 64-bit hash each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = data, offsets
        size = len(data)
        space = SPACE[data]
        begin = ~space
        begin[1:] &= space[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[heads] = ~space[heads]
        last = ~space
        last[:-1] &= space[1:]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        last[tails] = ~space[tails]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.n = np.diff(self.first)
        self.first = self.first[:-1]
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        if len(self.start):
            inside = np.flatnonzero(~space)
            value = _BYTE[LOWER[data[inside]] if lower else data[inside]]
            length = self.end - self.start
            at = np.concatenate(([0], np.cumsum(length)[:-1]))
            value *= power_of(np.arange(len(inside)) - np.repeat(at, length))
            self.hash = mix(np.add.reduceat(value, at) + length.astype(np.uint64) * _MUL)
        else:
            self.hash = np.zeros(0, np.uint64)
        self.size = size

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Every run of ``k`` words inside one text: index of its first word, and a 64-bit hash."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * powers(BASE, n), dtype=np.uint64)))
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return at, mix((sums[at + k] - sums[at]) * powers(BASE_INV, n)[at] + np.uint64(k))


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of a string column of about ``limit`` bytes: (rows, bytes, offsets); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = min(i + CHUNK_ROWS, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield slice(i, j), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and counts."""
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int64()), pa.array(values, kind)).cast(pa.list_(kind))
