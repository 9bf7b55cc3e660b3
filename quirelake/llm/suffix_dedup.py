"""Suffix-array dedup: bytes that repeat a long string of a document with a smaller id.

Strings of `length` bytes are found by winnowing: each has one anchor, the k-gram with the least
hash in it, and the strings of an anchor are one segment. Equal segments are folded by hash. Where
an anchor stands in different segments, Burrows-Wheeler transforms of the segments' shards are
merged by iterative interleave refinement; its blocks after d rounds are the intervals of suffixes
with a common prefix of d symbols, which gives the repeated strings without sorting suffixes anew.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashfiles import Files, by_shard, cuts, joined, local_folder, runs, write
from .shared import beside, mapped_pairs, small_batches, stage_path, table, text_of
from .words import P, chunks, mixed, powers

#: Bytes of a repeated string, of an anchor, and of the context that splits an anchor's segments.
LENGTH, K, SIDE = 50, 24, 13
#: Anchors that a map task folds at once; bytes of text for each shard of the files, about.
FOLD, SHARD_BYTES = 2 << 20, 24 << 20
#: Shards of documents whose transforms are merged, by a hash of the id; symbols in one merge.
PARTS, SYMBOLS = 16, 1 << 21
#: An anchor in more different segments than this has its strings folded one by one, so that no group of segments outgrows a task.
HOT = 1 << 16
#: Bytes of text whose windows are hashed at once.
CHUNK = 1 << 20

_forward = _back = np.zeros(0, np.uint64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


class Rolling:
    """Hashes of any slices of data."""

    def __init__(self, data: np.ndarray):
        global _forward, _back
        if len(_forward) <= len(data):
            n = max(len(data) + 1, CHUNK + 1)
            _forward, _back = powers(P, n), powers(pow(P, -1, 1 << 64), n)
        self.total, self.data, self.second = np.zeros(len(data) + 1, np.uint64), data, None
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _forward[: len(data)], out=self.total[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mixed((self.total[b] - self.total[a]) * _back[a])

    def check(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """64 more bits of a slice, from other numbers for the bytes."""
        if self.second is None:
            self.second = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * _forward[: len(self.data)], out=self.second[1:])
        return mixed((self.second[b] - self.second[a]) * _back[a])


@dataclass
class Segments:
    """Of a chunk of texts, in order: anchor hash, hash of anchor and bytes and more bits of it, row, first and last window, anchor position."""

    anchor: np.ndarray
    key: np.ndarray
    check: np.ndarray
    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    at: np.ndarray
    rolling: Rolling

    def windows(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All windows of the segments k: their segment, place, hash and more bits of it."""
        n = self.hi[k] - self.lo[k] + 1
        place = np.repeat(self.lo[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(k, n), place, self.rolling.of(place, place + LENGTH), self.rolling.check(place, place + LENGTH)


def segments(data: np.ndarray, bounds: np.ndarray) -> Segments:
    """The windows of each text, by their anchors."""
    w, n, rolling = LENGTH - K + 1, len(data), Rolling(data)
    if n < LENGTH:
        none, zero = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return Segments(none, none, none, zero, zero, zero, zero, rolling)
    g = mixed((rolling.total[K:] - rolling.total[:-K]) * _back[: n - K + 1])
    place = np.uint64(n.bit_length())
    least = g >> place << place | np.arange(len(g), dtype=np.uint64)  # of equal hashes the first position
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: len(g) - w + 1], least[w - size : w - size + len(g) - w + 1])
    at = (least & np.uint64((1 << int(place)) - 1)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(at)]
    p = np.flatnonzero(np.arange(len(at)) + LENGTH <= bounds[row + 1])
    at, row = at[p], row[p]
    start = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)]) if len(p) else np.zeros(0, np.int64)
    lo, hi, at, row = p[start], p[np.r_[start[1:], len(p)] - 1] if len(p) else p, at[start], row[start]
    anchor = g[at]
    shape = mixed(((at - lo) << 8 | (hi - lo)).astype(np.uint64))
    inside = rolling.of(lo, hi + LENGTH) + shape
    return Segments(anchor, mixed(inside ^ anchor), rolling.check(lo, hi + LENGTH) ^ shape, row, lo, hi, at, rolling)


def pieces(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, bytes, bounds) of a chunk; a long text in pieces that share the bytes of the windows between them.

    A cut gives other segments of the same anchors, which are told apart like any.
    """
    if len(data) <= 2 * size:
        yield 0, data, bounds
        return
    for a in range(0, max(1, len(data) - LENGTH + 1), size):
        part = data[a : a + size + LENGTH - 1]
        yield a, part, np.array([0, len(part)])


@dataclass
class Sides:
    """Records of conflicting segments: each window lies in one that holds SIDE bytes before or behind the anchor."""

    of: np.ndarray  # index into the segments
    group: np.ndarray
    more: np.ndarray  # more bits of the group
    key: np.ndarray
    check: np.ndarray
    first: np.ndarray  # number of the first window within the segment
    lo: np.ndarray
    hi: np.ndarray
    block: np.ndarray  # where the bytes that the group shares begin


def sides(s: Segments, k: np.ndarray, bits: int) -> Sides:
    off, n = s.at[k] - s.lo[k], s.hi[k] - s.lo[k]
    left, right = off >= SIDE, n > off - SIDE
    of = np.r_[k[left], k[right]]
    first = np.r_[np.zeros(left.sum(), np.int64), np.maximum(0, off - SIDE + 1)[right]]
    last = np.r_[np.minimum(n, off - SIDE)[left], n[right]]
    block = np.r_[(s.at[k] - SIDE)[left], s.at[k][right]]
    side = np.r_[np.zeros(left.sum(), np.uint64), np.ones(right.sum(), np.uint64)]
    group, more = mixed(s.rolling.of(block, block + SIDE + K) + side), s.rolling.check(block, block + SIDE + K) + side
    top = np.uint64(bits)
    key = group >> (np.uint64(64) - top) << (np.uint64(64) - top) | mixed(s.key[of] ^ group) >> top
    return Sides(of, group, more, key, s.check[of] + side, first, s.lo[of] + first, s.lo[of] + last, block)


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each suffix and the suffixes, sorted by `depth` symbols. Strings end with 0."""
    order = np.arange(len(text))
    for _ in range(depth):
        before = order - 1
        before[order == 0] = len(text) - 1
        order = before[np.argsort(text[before], kind="stable")]
    before = order - 1
    before[order == 0] = len(text) - 1
    return text[before], order


def interleave(one: np.ndarray, two: np.ndarray, depth: int, blocks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """From which of two transforms each suffix of their union comes, refined by a symbol a round.

    With blocks, also the number of the block of suffixes with the same first `depth` symbols.
    """
    which = np.r_[np.zeros(len(one), bool), np.ones(len(two), bool)]
    block = np.zeros(len(which), np.int32)
    symbols = np.empty(len(which), one.dtype)
    for _ in range(depth):
        symbols[~which], symbols[which] = one, two
        order = np.argsort(symbols, kind="stable")
        which = which[order]
        if blocks:
            s, b = symbols[order], block[order]
            block = np.zeros(len(which), np.int32)
            np.cumsum((s[1:] != s[:-1]) | (b[1:] != b[:-1]), out=block[1:])
    return which, block


def merged(texts: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts (positions in their concatenation), sorted by depth symbols, and their blocks."""
    base = np.cumsum([0, *map(len, texts)])
    parts = [(bwt, order + base[i]) for i, (bwt, order) in enumerate(transform(t, depth) for t in texts)]
    if len(parts) == 1:
        parts.append((np.zeros(0, texts[0].dtype), np.zeros(0, np.int64)))
    while True:
        final, out = len(parts) == 2, []
        for i in range(0, len(parts) - 1, 2):
            (a, x), (b, y) = parts[i : i + 2]
            which, block = interleave(a, b, depth, final)
            bwt, order = np.empty(len(which), a.dtype), np.empty(len(which), np.int64)
            bwt[~which], bwt[which], order[~which], order[which] = a, b, x, y
            out.append((bwt, order))
        if final:
            return order, block
        parts = [*out, *parts[len(parts) & ~1 :]]


def earlier(number: np.ndarray, doc: np.ndarray, windows: np.ndarray, left: np.ndarray, symbols: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Of each record a mask of its windows that also occur in a record of a smaller doc.

    Records are sorted by the number of their group. symbols: their bytes without those that the
    group shares, one after the other; left: how many stand before these; there are windows +
    depth - 2 for each. Each shard of documents gets a transform, and these are merged in pairs.
    """
    depth = LENGTH - K - SIDE + 1
    mask = np.zeros(len(number), np.uint64)
    size = windows + depth - 2
    ends = np.cumsum(size)
    shard = (mixed(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.uint16)
    i = 0
    while i < len(number):
        # whole groups: at most SYMBOLS symbols, unless one has more, and few enough numbers for 16 bits
        j = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SYMBOLS, "right"))
        j = min(max(j, i + 1), int(np.searchsorted(number, number[i] + 65000)))
        j = int(np.searchsorted(number, number[j], "left")) if j < len(number) else j
        if j <= i:
            j = int(np.searchsorted(number, number[i], "right"))
        of = i + np.argsort(shard[i:j], kind="stable")  # records by shard of documents
        n = size[of] + 2
        start = np.cumsum(n) - n
        text = np.zeros(int(n.sum()), np.uint16)
        own = np.ones(len(text), bool)
        own[start + left[of]] = own[start + n - 1] = False
        take = np.repeat(ends[of] - size[of] - (np.cumsum(size[of]) - size[of]), size[of]) + np.arange(size[of].sum())
        text[own] = symbols[take].astype(np.uint16) + 1
        text[start + left[of]] = 257 + number[of] - number[i]
        cut = [*start[runs(shard[of])].tolist(), len(text)]
        order, blocks = merged([text[a:b] for a, b in zip(cut, cut[1:], strict=False)], depth)
        record = np.searchsorted(start, order, "right") - 1
        window, record = order - start[record], of[record]
        good = np.flatnonzero(window < windows[record])
        record, window, blocks = record[good], window[good], blocks[good]
        at = runs(blocks)
        first = np.repeat(np.minimum.reduceat(doc[record], at), np.diff(np.r_[at, len(record)])) if len(at) else doc[:0]
        hit = first < doc[record]
        np.bitwise_or.at(mask, record[hit], np.uint64(1) << window[hit].astype(np.uint64))
        i = j
    return mask


_BLOBS = pa.schema([("shard", pa.int32()), *((x, pa.binary()) for x in "abcdefg")])
_NAMES = "shard int, a binary, b binary, c binary, d binary, e binary, f binary, g binary"


def _batch(rows: list[tuple[int, tuple[bytes, ...]]]) -> pa.RecordBatch:
    full = [(shard, *blobs, *[b""] * (7 - len(blobs))) for shard, blobs in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], t.type) for i, t in enumerate(_BLOBS)], schema=_BLOBS)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


@dataclass
class Found:
    """Files: first documents of repeated segments, numbers of segments of anchors that have several, and strings of these that repeat."""

    bits: int
    segments: Files
    several: Files
    windows: Files
    strings: Files
    hot: int = HOT

    def parts(self, s: Segments, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments that occur in a smaller id; first occurrences whose anchor has some other segments, and has many."""
        known, (first,) = self.segments.find(s.key, s.check)
        whole = known & (ids[s.row] > first)
        mine = np.flatnonzero(known & (ids[s.row] == first))
        _, (n,) = self.several.find(s.anchor[mine])
        return np.flatnonzero(whole), mine[(n > 1) & (n <= self.hot)], mine[n > self.hot]

    def windows_of(self, s: Segments, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first window, window after the last) of the runs of windows that repeat a smaller id."""
        whole, some, many = self.parts(s, ids)
        a, b = [s.lo[whole]], [s.hi[whole] + 1]
        if len(some):
            records = sides(s, some, self.bits)
            hit, (mask,) = self.windows.find(records.key, records.check)
            for j in range(int((records.hi - records.lo).max(initial=-1)) + 1):
                on = hit & (mask >> np.uint64(j) & np.uint64(1) > 0)
                a.append(records.lo[on] + j), b.append(records.lo[on] + j + 1)
        if len(many):
            of, place, key, check = s.windows(many)
            hit, (first,) = self.strings.find(key, check)
            place = place[hit & (first < ids[s.row[of]])]
            a.append(place), b.append(place + 1)
        return np.concatenate(a), np.concatenate(b)


def _changes(*sorted_by: np.ndarray) -> np.ndarray:
    """Where runs of rows with equal entries start."""
    return np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)]) if len(sorted_by[0]) else np.zeros(0, np.int64)


def _least(key: np.ndarray, check: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of each distinct key and check, in order, where its smallest doc stands."""
    order = np.lexsort((doc, check, key))
    return order[_changes(key[order], check[order])]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None, parts: int = PARTS, hot: int = HOT) -> Found:
    """Three passes over the texts: shared anchors, their distinct segments, strings of anchors with several segments.

    Anchors, segments and strings are dealt by their hashes after each map task has folded its own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(6, (size // SHARD_BYTES).bit_length())
    folder = local_folder(stage_path(spark, "suffix"))
    os.makedirs(folder, exist_ok=True)
    shared = Files(folder, "anchor", bits, {})
    found = Found(bits, Files(folder, "segment", bits, {"first": np.int64}), Files(folder, "several", bits, {"n": np.uint32}), Files(folder, "window", bits, {"mask": np.uint64}), Files(folder, "string", bits, {"first": np.int64}), hot)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Segments]]:
        for batch in batches:
            ids = _ids(batch.column(0))
            for i, j, data, bounds in chunks(batch.column(1), CHUNK):
                for _, part, within in pieces(data, bounds, CHUNK):
                    yield ids[i:j], part, segments(part, within)

    def folded(each_part: Iterator[tuple[np.ndarray, ...]], fold) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in each_part:
            held.append(part)
            n += len(part[0])
            if n >= FOLD:
                yield _batch(fold(*map(np.concatenate, zip(*held, strict=True))))
                held, n = [], 0
        if n:
            yield _batch(fold(*map(np.concatenate, zip(*held, strict=True))))

    def shard_in(data: pa.Table) -> int:
        return data.column("shard")[0].as_py()

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fold(anchor: np.ndarray, doc: np.ndarray) -> list:
            order = np.lexsort((doc, anchor))
            anchor, doc = anchor[order], doc[order]
            at = runs(anchor)
            many = doc[at] != doc[np.r_[at[1:], len(doc)] - 1]
            one, two = dict(by_shard(bits, anchor[at][~many])), dict(by_shard(bits, anchor[at][many]))
            return [(x, (*one.get(x, (b"",)), *two.get(x, (b"",)))) for x in one.keys() | two.keys()]

        yield from folded(((s.anchor, ids[s.row]) for ids, _, s in each(batches)), fold)

    def merge_anchors(data: pa.Table) -> pa.Table:
        one, two = np.sort(joined(data.column("a"), np.uint64)), joined(data.column("b"), np.uint64)
        keys = np.union1d(one[1:][one[1:] == one[:-1]], two)
        write(folder, f"anchor-{shard_in(data)}", key=keys)
        return pa.table({"shard": [shard_in(data)], "made": pa.array([[]], pa.list_(pa.int64()))})

    def count_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fold(key: np.ndarray, check: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> list:
            at = _least(key, check, doc)
            return by_shard(bits, key[at], check[at], anchor[at], doc[at])

        def shared_ones():
            for ids, _, s in each(batches):
                on, _ = shared.find(s.anchor)
                yield s.key[on], s.check[on], s.anchor[on], ids[s.row[on]]

        yield from folded(shared_ones(), fold)

    def merge_segments(data: pa.Table) -> pa.Table:
        key, check, anchor, doc = (joined(data.column(c), kind) for c, kind in (("a", np.uint64), ("b", np.uint64), ("c", np.uint64), ("d", np.int64)))
        at = _least(key, check, doc)
        write(folder, f"segment-{shard_in(data)}", key=key[at], check=check[at], first=doc[at])
        names, n = np.unique(anchor[at], return_counts=True)
        done = np.array([shard_in(data)]).tobytes()
        return pa.Table.from_batches([_batch([(shard, (*blobs, done)) for shard, blobs in by_shard(bits, names, n.astype(np.uint32))])])

    def merge_several(data: pa.Table) -> pa.Table:
        anchor, n = joined(data.column("a"), np.uint64), joined(data.column("b"), np.uint32).astype(np.int64)
        order = np.argsort(anchor, kind="stable")
        at = runs(anchor[order])
        total = np.add.reduceat(n[order], at) if len(at) else n
        keep = total > 1
        write(folder, f"several-{shard_in(data)}", key=anchor[order][at][keep], n=np.minimum(total[keep], 2**32 - 1).astype(np.uint32))
        return pa.table({"shard": [shard_in(data)], "made": [sorted(set(joined(data.column("c"), np.int64).tolist()))]})

    def count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def strings() -> pa.RecordBatch:
            key, check, doc = map(np.concatenate, zip(*held, strict=True))
            at = _least(key, check, doc)
            return _batch([(shard + (1 << bits), blobs) for shard, blobs in by_shard(bits, key[at], check[at], doc[at])])

        for ids, data, s in each(batches):
            _, some, many = found.parts(s, ids)
            if len(many):
                of, _, key, check = s.windows(many)
                held.append((key, check, ids[s.row[of]]))
                n_held += len(key)
                if n_held >= FOLD:
                    yield strings()
                    held, n_held = [], 0
            r = sides(s, some, bits)
            pick = np.lexsort((r.check, r.key))
            pick = pick[_changes(r.key[pick], r.check[pick])]
            size = (r.block - r.lo)[pick], (r.hi + LENGTH - r.block - K - SIDE)[pick]
            out = []
            shard = (r.group[pick] >> np.uint64(64 - bits)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for a, b in cuts(shard[order]):
                mine = order[a:b]
                k = pick[mine]
                before, behind = size[0][mine], size[1][mine]
                n = np.c_[before, behind].ravel()
                begin = np.c_[r.lo[k], r.block[k] + K + SIDE].ravel()
                byte = data[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                wide = np.c_[r.hi[k] - r.lo[k] + 1, before].astype(np.uint8)
                out.append((int(shard[mine[0]]), (r.group[k].tobytes(), r.more[k].tobytes(), r.key[k].tobytes(), r.check[k].tobytes(), ids[s.row[r.of[k]]].tobytes(), wide.tobytes(), byte.tobytes())))
            if out:
                yield _batch(out)
        if held:
            yield strings()

    def merge_windows(data: pa.Table) -> pa.Table:
        done = pa.table({"shard": [shard_in(data)], "made": pa.array([[]], pa.list_(pa.int64()))})
        if shard_in(data) >= 1 << bits:
            key, check, doc = joined(data.column("a"), np.uint64), joined(data.column("b"), np.uint64), joined(data.column("c"), np.int64)
            at = _least(key, check, doc)
            write(folder, f"string-{shard_in(data) - (1 << bits)}", key=key[at], check=check[at], first=doc[at])
            return done
        group, more, key, check, doc = (joined(data.column(c), kind) for c, kind in zip("abcde", (np.uint64, np.uint64, np.uint64, np.uint64, np.int64), strict=True))
        n, left = joined(data.column("f"), np.uint8).astype(np.int64).reshape(-1, 2).T
        byte = joined(data.column("g"), np.uint8)
        size = n + LENGTH - K - SIDE - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((check, key, more, group))
        order = order[_changes(group[order], more[order], key[order], check[order])]
        count = np.diff(np.r_[_changes(group[order], more[order]), len(order)])
        order = order[np.repeat(count > 1, count)]
        number = np.zeros(len(order), np.int64)
        number[_changes(group[order], more[order])[1:]] = 1
        number = np.cumsum(number)
        take = np.repeat(begin[order] - (np.cumsum(size[order]) - size[order]), size[order]) + np.arange(size[order].sum())
        mask = earlier(number, doc[order], n[order], left[order], byte[take], parts)
        keep = np.flatnonzero(mask)
        at = keep[np.lexsort((check[order][keep], key[order][keep]))]
        write(folder, f"window-{shard_in(data)}", key=key[order][at], check=check[order][at], mask=mask[at])
        return done

    def run(count, *merges) -> tuple[list[int], list[int]]:
        """The shards that the last merge wrote, and those before it."""
        job = rows.mapInArrow(count, _NAMES)
        for merge in merges[:-1]:
            job = job.groupBy("shard").applyInArrow(merge, _NAMES)
        made = job.groupBy("shard").applyInArrow(merges[-1], "shard long, made array<long>").collect()
        return [r.shard for r in made], [x for r in made for x in r.made]

    shared.seal(run(count_anchors, merge_anchors)[0])
    several, first = run(count_segments, merge_segments, merge_several)
    found.segments.seal(first)
    found.several.seal(several)
    last, _ = run(count_windows, merge_windows)
    found.windows.seal([x for x in last if x < 1 << bits])
    found.strings.seal([x - (1 << bits) for x in last if x >= 1 << bits])
    return found


def suffix_dedup(docs: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", found: Found | None = None, parts: int = PARTS, hot: int = HOT) -> DataFrame:
    """keep's columns of every row, _n_bytes, _starts and _ends (bytes of the removed runs), _kept (binary).

    Null texts are empty; matches do not cross texts. Ids are compared as long integers; a null id
    is smaller than any other. Rows with equal ids remove nothing from each other. What is removed
    is judged on the input. Strings and segments are told apart by 128 bits of hashes, so at 10^13
    of them some two are confused with a chance of 10^-12. Texts below LENGTH bytes stay; a text of
    any length is read whole. An empty table gives no row. keep may hold columns of any name; one
    named like a result gives way to it.
    """
    found = found or find(docs, id_col, text_col, parts=parts, hot=hot)

    def run(texts: pa.Array, column: pa.Array) -> pa.Array:
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        ids, rows = _ids(column), []
        for i, j, data, bounds in chunks(texts, CHUNK):
            step = np.zeros(len(data) + 1, np.int32)
            for offset, part, within in pieces(data, bounds, CHUNK):
                a, b = found.windows_of(segments(part, within), ids[i:j])
                np.add.at(step, a + offset, 1)
                np.add.at(step, b + (offset + LENGTH - 1), -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            edge = np.zeros(len(data) + 1, bool)
            edge[bounds] = True
            start = np.flatnonzero(gone & (np.r_[True, ~gone[:-1]] | edge[:-1]))
            end = np.flatnonzero(gone & (np.r_[~gone[1:], True] | edge[1:])) + 1
            at = np.searchsorted(start, bounds)
            for x in range(j - i):
                lo, hi = int(bounds[x]), int(bounds[x + 1])
                mine = slice(int(at[x]), int(at[x + 1]))
                kept = data[lo:hi] if at[x] == at[x + 1] else data[lo:hi][~gone[lo:hi]]
                rows.append((hi - lo, start[mine] - lo, end[mine] - lo, kept.tobytes()))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else ([],) * 4, kinds, strict=True)]
        return pa.StructArray.from_arrays(columns, ["n_bytes", "starts", "ends", "kept"])

    kind = "n_bytes long, starts array<long>, ends array<long>, kept binary"
    x = mapped_pairs(docs.sparkSession, run, kind, F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long"))
    return beside(docs, keep, x, {"n_bytes": "_n_bytes", "starts": "_starts", "ends": "_ends", "kept": "_kept"})


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    removed = F.aggregate(F.zip_with("_ends", "_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select("doc_id", F.col("_n_bytes").alias("n_bytes"), removed.alias("n_removed"), F.size("_starts").cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))


#: Bytes as hex digits; windows of equal bytes meet by their digits, so this is for small tables.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT r, doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT r, doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS p FROM d WHERE len(h) >= {2 * LENGTH})),
f AS MATERIALIZED (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
g AS MATERIALIZED (SELECT r, p FROM w JOIN f USING (s) WHERE first < doc_id),
e AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM g),
k AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM e),
s AS MATERIALIZED (SELECT r, k, min(p) AS a, max(p) + {LENGTH} AS b FROM k GROUP BY r, k),
c AS (SELECT r, b, coalesce(lead(a) OVER (PARTITION BY r ORDER BY a), 1000000000) AS a FROM (SELECT r, a, b FROM s UNION ALL SELECT r, -1, 0 FROM d)),
t AS (SELECT r, string_agg(substr(h, 2 * b + 1, 2 * least(a - b, len(h))), '' ORDER BY b) AS kept FROM c JOIN d USING (r) GROUP BY r),
n AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (r) LEFT JOIN n USING (r)
"""
