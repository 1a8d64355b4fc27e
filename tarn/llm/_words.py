"""Words, word hashes and n-gram hashes of whole Arrow text columns, vectorised over the UTF-8 bytes.

A chunk of many texts is handled at once: word borders come from a 256-entry byte table, the hash of each word
from one running polynomial sum modulo 2**64, and the hash of an n-gram from the hashes of its words.
Nothing here loops over characters, and memory is bounded by ``CHUNK_BYTES`` (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_STEP = 0xD1342543DE82EF95

#: bytes outside [\x20\x09-\x0D] belong to words
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lowered
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 32

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, CHUNK_BYTES + 1)
        _pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE_INV)]), dtype=np.uint64)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of consecutive texts: ``start``/``end`` byte offsets, ``doc`` number, ``hash``; ``first[d]:first[d+1]`` are those of text d."""

    __slots__ = ("data", "start", "end", "doc", "hash", "first", "offsets")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED, fold: np.ndarray = SAME):
        n = len(data)
        self.data, self.offsets = data, offsets
        inside = np.zeros(n + 1, bool)
        inside[:n] = table[data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        before[offsets] = False
        self.start = np.flatnonzero(inside & ~before)
        after = inside.copy()
        after[offsets] = False
        self.end = np.flatnonzero(inside[:n] & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((fold[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * inverse[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words, and whether each lies within one text (positions are word numbers)."""
        h = ngrams(self.hash, k)
        return h, self.doc[: len(h)] == self.doc[k - 1 :] if len(h) else np.zeros(0, bool)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of each run of k values, by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, power, width = None, 0, h, 1
    while True:
        if k & width:
            if out is None:
                out, have = power, width
            else:
                m = len(h) - have - width + 1
                out = out[:m] * np.uint64(pow(_STEP, width, 1 << 64)) + power[have : have + m]
                have += width
        if have == k:
            return mix(out)
        power = power[: len(power) - width] * np.uint64(pow(_STEP, width, 1 << 64)) + power[width:]
        width *= 2


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of at most about ``limit`` bytes together; a longer text stands alone."""
    data, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_chunks(column, table=SPACED, fold=SAME, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for i, j, data, offsets in chunks(column, limit):
        yield i, j, Words(data, offsets, table, fold)


def dilate(flags: np.ndarray, back: int, ahead: int) -> np.ndarray:
    """True at i where any of flags[i-back .. i+ahead] is."""
    total = np.concatenate([[0], np.cumsum(flags)])
    n = np.arange(len(flags))
    return total[np.minimum(n + ahead + 1, len(flags))] > total[np.maximum(n - back, 0)]


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by doubling."""
    if len(values) < w:
        return values[:0]
    m, width = values, 1
    while width * 2 <= w:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(values) - w + 1], m[w - width : w - width + len(values) - w + 1])
