"""Words of UTF-8 texts and their hashes, a few megabytes of text at a time, in NumPy.

Hashes decide what is looked at; whoever needs certainty compares the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa

_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: By byte: what it counts for in a word's hash, A-Z as a-z.
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_WEIGHT = mixed((_LOWER.astype("u8") + _ONE) * np.uint64(0xD1B54A32D192ED03))


def alphabet(other: str) -> np.ndarray:
    """By byte, whether it stands in a word; ``other`` lists the ASCII characters that don't."""
    table = np.ones(256, bool)
    table[[ord(c) for c in other]] = False
    return table


#: Words are runs of a-z, 0-9 and all beyond ASCII, after A-Z are lowered.
PLAIN = alphabet("".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])))
#: Weights that tell capitals apart, two kinds.
EXACT = tuple(mixed((np.arange(256, dtype="u8") + _ONE) * np.uint64(c)) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))
#: Words are what white space parts.
SPACED = alphabet(" \t\n\v\f\r")
#: Words are lines that are not empty.
LINES = alphabet("\n")

_powers = np.ones((2, 1), "u8")


def _power_tables(n: int) -> np.ndarray:
    global _powers
    if _powers.shape[1] <= n:
        size = max(n + 1, (1 << 20) + 2)
        up, down = np.full(size, _BASE), np.full(size, _UNBASE)
        up[0] = down[0] = _ONE
        _powers = np.stack([np.cumprod(up), np.cumprod(down)])
    return _powers


class Words:
    """Words of consecutive texts: byte ranges, hashes, and the range of words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, weight: np.ndarray = _WEIGHT):
        self.data, self.offsets = data, offsets
        inside = table[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[first] = inside[first]
        end[first[first > 0] - 1] = inside[first[first > 0] - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        up, down = _power_tables(len(data) + 1)
        self._total = np.zeros(len(data) + 1, "u8")
        np.cumsum(weight[data] * up[: len(data)], out=self._total[1:])
        self._down = down[self.starts]
        self.lengths = self.ends - self.starts
        self.hashes = self._hash(self.ends)

    def _hash(self, ends: np.ndarray) -> np.ndarray:
        return mixed((self._total[ends] - self._total[self.starts]) * self._down)

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of ranges of bytes; that of none is 0."""
        return mixed((self._total[end] - self._total[begin]) * _power_tables(len(self.data) + 1)[1][begin])

    def lowered(self, at: np.ndarray) -> np.ndarray:
        """The bytes at these places, lowered; any where the place is outside."""
        return _LOWER[self.data[np.clip(at, 0, max(len(self.data) - 1, 0))]].astype("i8") if len(self.data) else np.zeros(len(at), "i8")

    def only(self, at: np.ndarray) -> "Words":
        """The words at these places by themselves: spellings and hashes; ``bounds`` no longer hold."""
        w = copy(self)
        w.starts, w.ends, w.lengths, w.hashes, w._down = (a[at] for a in (self.starts, self.ends, self.lengths, self.hashes, self._down))
        return w

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the ``k`` words from each word on, also across the ends of texts."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, "u8")
        g = np.zeros(n, "u8")
        for j in range(k):
            g = (g + self.hashes[j : j + n]) * _BASE
        return mixed(g)

    def gram_docs(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the ``k``-grams that lie in one text, and the text of each."""
        n = np.maximum(np.diff(self.bounds) - (k - 1), 0)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bounds[:-1], n)
        return at, doc

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes().lower()


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings without nulls, and where each begins."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, "i8" if wide else "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    bytes_ = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with about ``size`` bytes in column ``text`` (one longer text alone), with those bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = column_bytes(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi
