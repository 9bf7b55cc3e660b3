"""Words of many texts at once, as numpy arrays over the Arrow buffers of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a chunk of its own.
CHUNK = 2 << 20
#: Odd multipliers of the rolling hashes, modulo 2**64.
P, Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and all that is not ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Bytes of words that ASCII white space separates.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_forward = _back = np.zeros(0, np.uint64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, segment: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each slice of data; slices are in order and do not overlap."""
    global _forward, _back
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + segment, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        if len(_forward) <= b - a:
            _forward, _back = powers(P, max(segment, b - a) + 1), powers(pow(P, -1, 1 << 64), max(segment, b - a) + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _forward[: b - a], out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[ends[i:j] - a] - total[s]) * _back[s]
        i = j
    return mixed(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(Q)
        out += h[j : j + n]
    return mixed(out)


def winnow(g: np.ndarray, group: np.ndarray, last: np.ndarray, w: int) -> np.ndarray:
    """Mask of the minima of every w consecutive hashes of one group; ties all count.

    group: of each hash the group of its first entry; last: of its last entry.
    """
    n, chosen = len(g) - w + 1, np.zeros(len(g), bool)
    if n <= 0:
        return chosen
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    whole = group[:n] == last[w - 1 : w - 1 + n]
    for j in range(w):
        chosen[j : j + n] |= whole & (g[j : j + n] == least)
    return chosen


class Words:
    """data: lower-cased bytes; of each word starts, ends, doc (row within the column slice), hash."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word: np.ndarray = WORD):
        self.data = LOWER[data]
        inside = word[self.data]
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:] & ~(~before[1:] & inside[1:])
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1
        self.hash = hashes(self.data, self.starts, self.ends)
        self.counts = np.bincount(self.doc, minlength=len(bounds) - 1)

    def __len__(self) -> int:
        return len(self.starts)

    def texts(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b], strict=True)]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row bounds of a text column; null as empty. The bytes are not copied unless there are nulls."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(bounds, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8), at


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds within these bytes) of whole texts."""
    data, at = buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j
