"""LM scoring: an interpolated, modified Kneser-Ney model of trigrams.

Spark counts the trigrams: map tasks fold theirs, shards by middle word merge them, and there both
the contexts before a word and the continuations behind it are complete. The model is sorted
arrays of hashes with counts, in files of the shared folder that workers map into memory.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashfiles import Files, cuts, local_folder, runs, within, write
from .shared import beside, drop_shuffles, mapped, small_batches, stage_path, staged, table, text_of, trim
from .words import SPACED, Words, chunks, mixed

#: Hashes of what precedes a text and of its end.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
K = np.uint64(0x9E3779B97F4A7C15)
#: Tokens that a map task folds at once, and that a shard has, about.
FOLD, TARGET = 3 << 19, 3 << 19
#: Passes over the texts, each for a part of the shards, whose intermediate files go before the next.
ROUNDS = 2
#: Continuations of a context beyond which its sums are kept.
LONG = 16
#: Bits of a word behind those of its context in a key.
TAIL = np.uint64(28)
#: A count of one byte that stands for a larger one, which is kept apart.
MORE = 255


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of a chunk of texts, each followed by its end; the one before each, the one before that; tokens of each text."""
    words = Words(data, bounds, SPACED)
    sizes = words.counts + 1
    after = np.cumsum(sizes)
    out = np.full(int(after[-1]), END)
    inside = np.ones(len(out), bool)
    inside[after - 1] = False
    out[inside] = words.hash
    before, far = np.empty_like(out), np.empty_like(out)
    before[1:] = out[:-1]
    before[after - sizes] = START
    far[1:] = before[:-1]
    far[after - sizes] = START
    return out, before, far, sizes


def bucket(v: np.ndarray, bits: int) -> np.ndarray:
    return (mixed(v) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Plan:
    """Of each bucket of middle words its first shard and its number of shards: one, that others may share, or several of a hot one."""

    bits: int
    first: np.ndarray
    parts: np.ndarray
    shards: int

    def of(self, v: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Shards of middle words; `other` deals those of a hot bucket."""
        b = bucket(v, self.bits)
        return self.first[b] + (mixed(other) % self.parts[b].astype(np.uint64)).astype(np.int64)

    def hot(self) -> np.ndarray:
        """Whether each shard is one of several of a bucket."""
        out = np.zeros(self.shards, bool)
        for b in np.flatnonzero(self.parts > 1).tolist():
            out[self.first[b] : self.first[b] + self.parts[b]] = True
        return out


def planned(n: np.ndarray, target: int) -> Plan:
    """Shards of about target tokens from the tokens of each bucket."""
    first, parts, shard, held = np.zeros(len(n), np.int64), np.ones(len(n), np.int64), 0, 0
    for b, size in enumerate(n.tolist()):
        if size > 2 * target:
            shard += held > 0
            first[b], parts[b] = shard, -(-size // target)
            shard, held = shard + int(parts[b]), 0
            continue
        if held and held + size > target:
            shard, held = shard + 1, 0
        first[b] = shard
        held += size
    return Plan(len(n).bit_length() - 1, first, parts, shard + 1)


def counted(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by (v, u, w), sorted, and the sums of their counts (1 each without c)."""
    if not len(v):
        return v, u, w, np.zeros(0, np.int64)
    (vs, vi), (us, ui), (ws, wi) = (np.unique(x, return_inverse=True) for x in (v, u, w))
    bu, bw = len(us).bit_length(), len(ws).bit_length()
    if len(vs).bit_length() + bu + bw > 63:
        order = np.lexsort((wi, ui, vi))
        vi, ui, wi = vi[order], ui[order], wi[order]
        at = np.flatnonzero(np.r_[True, (vi[1:] != vi[:-1]) | (ui[1:] != ui[:-1]) | (wi[1:] != wi[:-1])])
        sums = np.diff(np.r_[at, len(v)]) if c is None else np.add.reduceat(c[order], at)
        return vs[vi[at]], us[ui[at]], ws[wi[at]], sums
    key = (vi.astype(np.uint64) << np.uint64(bu + bw)) | (ui.astype(np.uint64) << np.uint64(bw)) | wi.astype(np.uint64)
    if c is None:
        key.sort()
        at = runs(key)
        sums = np.diff(np.r_[at, len(key)])
    else:
        order = np.argsort(key)
        key = key[order]
        at = runs(key)
        sums = np.add.reduceat(c[order], at)
    key = key[at]
    low = lambda n: np.uint64((1 << n) - 1)
    return vs[(key >> np.uint64(bu + bw)).astype(np.int64)], us[(key >> np.uint64(bw) & low(bu)).astype(np.int64)], ws[(key & low(bw)).astype(np.int64)], sums


def packed(v: np.ndarray, u: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Rows sorted by v as bytes: words once each, rows by their numbers, equal v as runs."""
    names, index = np.unique(np.concatenate([v, u, w]), return_inverse=True)
    wide, many = np.uint16 if len(names) < 1 << 16 else np.uint32, np.uint8 if c.max() < 256 else np.uint64
    n, at = len(v), runs(v)
    head = np.array([len(names), len(at), n, wide().itemsize, many().itemsize], np.int64)
    size = np.diff(np.r_[at, n]).astype(np.uint32)
    return b"".join(x.tobytes() for x in (head, names, index[:n][at].astype(wide), size, index[n : 2 * n].astype(wide), index[2 * n :].astype(wide), c.astype(many)))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names, some, n, wide, many = np.frombuffer(data, np.int64, 5).tolist()
    at, out = 40, []
    for size, kind in ((names, "u8"), (some, f"u{wide}"), (some, "u4"), (n, f"u{wide}"), (n, f"u{wide}"), (n, f"u{many}")):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    words, vi, length, ui, wi, c = out
    return words[np.repeat(vi, length)], words[ui], words[wi], c.astype(np.int64)


def context(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The first bits of the keys of a context's continuations."""
    return mixed(u * K + v) >> TAIL << TAIL


def tail(w: np.ndarray) -> np.ndarray:
    return w >> (np.uint64(64) - TAIL)


def save(folder: str, name: str, shard: int, key: np.ndarray, c: np.ndarray) -> None:
    """Sorted keys with counts of one byte, and the larger ones apart."""
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    write(folder, f"{name}-{shard}", key=key, c=np.minimum(c, MORE).astype(np.uint8))
    large = c >= MORE
    write(folder, f"{name}more-{shard}", key=key[large], n=c[large].astype(np.int64))


def _grouped(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys, sorted, and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = runs(keys)
    return keys[at], [np.add.reduceat(x[order], at) if len(at) else x for x in values]


def _sums(c: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of runs of counts that start at `at` the total, and how many are 1, 2, and more."""
    return [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (c, c == 1, c == 2, c >= 3)]


@dataclass
class Model:
    """Totals of the model and the folder of its arrays."""

    folder: str
    plan: Plan
    word_bits: int
    tokens: int = 0
    words: int = 0
    texts: int = 0
    pairs: int = 0
    discounts: tuple = ()  # of trigram counts (3), and continuation counts of bigrams (2) and words (1): for 0, 1, 2, 3 and more
    unseen: float = 1.0  # the share of the unigrams that goes to the uniform distribution

    def __post_init__(self) -> None:
        self.by_word = Files(self.folder, "word", self.word_bits, {x: None for x in ("c", "cc", "total", "n1", "n2", "n3")})
        self.three, self.three_more = Files(self.folder, "three", 0, {"c": np.uint8}), Files(self.folder, "threemore", 0, {"n": np.int64})
        self.two, self.two_more = Files(self.folder, "two", 0, {"c": np.uint8}), Files(self.folder, "twomore", 0, {"n": np.int64})
        self.long = Files(self.folder, "long", 0, {x: np.int64 for x in ("total", "n1", "n2", "n3")})

    def counts(self, files: Files, more: Files, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
        _, (c,) = files.find(key, shard=shard)
        c = c.astype(np.int64)
        large = np.flatnonzero(c == MORE)
        if len(large):
            _, (n,) = more.find(key[large], shard=shard[large])
            c[large] = n
        return c

    def contexts(self, key: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        """Total and numbers of ones, twos and more of the continuations of each context."""
        kept, out = self.long.find(key, shard=shard)
        short = np.flatnonzero(~kept)
        order = short[np.argsort(shard[short], kind="stable")]
        for a, b in cuts(shard[order]):
            mine = order[a:b]
            held = self.three.array(int(shard[mine[0]]), "key", np.uint64)
            c = self.three.array(int(shard[mine[0]]), "c", np.uint8)
            lo, hi = np.searchsorted(held, key[mine]), np.searchsorted(held, key[mine] + (np.uint64(1) << TAIL) - np.uint64(1), "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of = np.repeat(np.arange(len(mine)), n)
            value = c[at].astype(np.int64)
            large = np.flatnonzero(value == MORE)
            if len(large):
                _, (more,) = self.three_more.find(held[at[large]], shard=np.full(len(large), shard[mine[0]]))
                value[large] = more
            for x, y in zip(out, (value, value == 1, value == 2, value >= 3), strict=True):
                x[mine] = np.bincount(of, y, len(mine)).astype(np.int64)
        return out

    def score(self, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token whether it is known, its base and its log10 probability after u and v."""
        base = np.float64(self.tokens + 0.5 * (self.words + 1))
        d1, d2, d3 = self.discounts
        known, wi = np.unique(np.r_[w, START], return_inverse=True)
        vi = np.r_[wi[-1], wi[:-2]]
        vi[v == START], wi = wi[-1], wi[:-1]
        _, (c, cc, t2, m1, m2, m3) = self.by_word.find(known)
        c[known == END] = self.texts
        uniform = 1.0 / (self.words + 1)
        one = np.full(len(known), uniform) if not self.pairs else np.maximum(cc - d1[np.minimum(cc, 3)], 0) / self.pairs + self.unseen * uniform
        rest = (d2[1] * m1 + d2[2] * m2 + d2[3] * m3) / np.maximum(t2, 1)
        n = self.counts(self.two, self.two_more, context(v, v) | tail(w), self.plan.of(v, w))
        two = np.where(t2[vi] > 0, np.maximum(n - d2[np.minimum(n, 3)], 0) / np.maximum(t2[vi], 1) + rest[vi] * one[wi], one[wi])
        x, shard = context(u, v), self.plan.of(v, u)
        order = np.argsort(within(x, shard))
        xs, ss = x[order], shard[order]
        new = np.r_[True, (xs[1:] != xs[:-1]) | (ss[1:] != ss[:-1])]
        back = np.empty(len(x), np.int64)
        back[order] = np.cumsum(new) - 1
        t3, n1, n2, n3 = (y[back] for y in self.contexts(xs[new], ss[new]))
        n = self.counts(self.three, self.three_more, x | tail(w), shard)
        left = (d3[1] * n1 + d3[2] * n2 + d3[3] * n3) / np.maximum(t3, 1)
        p = np.where(t3 > 0, np.maximum(n - d3[np.minimum(n, 3)], 0) / np.maximum(t3, 1) + left * two, two)
        return c[wi] > 0, np.log10((c[wi] + 0.5) / base), np.log10(p)


def discounts(n: list[int]) -> np.ndarray:
    """Of counts 0, 1, 2, 3 and more, from how many have the counts 1 to 4.

    Kept within (0, count), so that every context leaves something to the lower order; a half where nothing is seen once.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if n1 and a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


#: What shards send on: values of words (roles 0 to 2), bigrams of hot words (3), and their own totals (4, 5).
CONTINUED, FOLLOWED, SEEN, PAIRS, THREES, TWOS = range(6)
_ROWS = pa.schema([("shard", pa.int32()), ("role", pa.int32()), ("key", pa.binary()), ("values", pa.binary())])
_NAMES = "shard int, role int, key binary, values binary"


def _table(rows: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_ROWS)], schema=_ROWS)


def train(docs: DataFrame, text_col: str = "text", target: int = TARGET, rounds: int = ROUNDS) -> Model:
    """Counts all rows of docs; null texts are an end alone. An empty table gives the uniform distribution.

    A first pass counts the tokens of each bucket of words, a fixed number of them. The driver plans
    shards of about target tokens from that: buckets share one, and a hot one has several, dealt
    by the word before. Shards grow in number with the text, so their size stays.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(text_of(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(22, max(16, (size >> 20).bit_length()))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                w, v, u, _ = tokens(data, bounds)
                for k in range(0, len(w), FOLD):
                    yield w[k : k + FOLD], v[k : k + FOLD], u[k : k + FOLD]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for _, v, _ in each(batches):
            total += np.bincount(bucket(v, bits), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["b", "n"])

    found = texts.mapInArrow(measure, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    sizes = np.zeros(1 << bits, np.int64)
    sizes[found.column("b").to_numpy()] = found.column("n").to_numpy()
    plan = planned(sizes, min(target, max(1, int(sizes.sum()) // 16)))
    hot, word_bits = plan.hot(), max(6, 3 * plan.shards.bit_length() // 4)
    folder = local_folder(stage_path(spark, "lm"))
    os.makedirs(folder, exist_ok=True)
    model = Model(folder, plan, word_bits)

    def by_word(role: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
        where = (keys >> np.uint64(64 - word_bits)).astype(np.int64)
        wide = np.uint32 if max((int(x.max(initial=0)) for x in values)) < 2**32 else np.uint64
        return [(int(where[a]), role, keys[a:b].tobytes(), np.stack([x[a:b] for x in values]).astype(wide).tobytes()) for a, b in cuts(where)]

    def two_of(shard: int, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> list[tuple[int, int, bytes, bytes]]:
        """Writes the bigrams of a shard, sorted by v, and gives what they say of words."""
        save(folder, "two", shard, context(v, v) | tail(w), n)
        at = runs(v)
        stats = np.array([shard, len(v), *((n == k).sum() for k in (1, 2, 3, 4))], np.int64)
        names, (continued,) = _grouped(w, np.ones(len(w), np.int64))
        return [*by_word(CONTINUED, names, continued), *by_word(FOLLOWED, v[at], *_sums(n, at)), (shard % (1 << word_bits), TWOS, b"", stats.tobytes())]

    def merge(data: pa.Table) -> pa.Table:
        shard = data.column("shard")[0].as_py()
        trim()  # of what the group before this one has left
        v, u, w, c = counted(*(np.concatenate(x) for x in zip(*(unpacked(x.as_py()) for x in data.column("values")), strict=True)))
        save(folder, "three", shard, context(u, v) | tail(w), c)
        at = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])])
        sums, length = _sums(c, at), np.diff(np.r_[at, len(v)])
        far = np.flatnonzero(length > LONG)
        key = context(u[at[far]], v[at[far]])
        order = np.argsort(key)
        write(folder, f"long-{shard}", key=key[order], **{name: x[far][order] for name, x in zip(("total", "n1", "n2", "n3"), sums, strict=True)})
        first = runs(v)
        stats = np.array([shard, int(c.sum()), *((c == k).sum() for k in (1, 2, 3, 4))], np.int64)
        rows = [*by_word(SEEN, v[first], np.add.reduceat(c, first)), (shard % (1 << word_bits), THREES, b"", stats.tobytes())]
        v, _, w, n = counted(v, np.zeros(len(v), np.uint64), w)
        if not hot[shard]:
            return _table(rows + two_of(shard, v, w, n))
        to = plan.of(v, w)
        order = np.argsort(to, kind="stable")
        for a, b in cuts(to[order]):
            x = order[a:b]
            rows.append((int(to[x[0]]), PAIRS, b"", packed(v[x], w[x], w[x], n[x])))
        return _table(rows)

    def merge_pairs(data: pa.Table) -> pa.Table:
        v, _, w, n = counted(*(np.concatenate(x) for x in zip(*(unpacked(x.as_py()) for x in data.column("values")), strict=True)))
        return _table(two_of(data.column("shard")[0].as_py(), v, w, n))

    def finish(data: pa.Table) -> pa.Table:
        shard, kept = data.column("shard")[0].as_py(), {CONTINUED: [], FOLLOWED: [], SEEN: []}
        stats = {THREES: np.zeros(6, np.int64), TWOS: np.zeros(6, np.int64)}
        made = {THREES: [], TWOS: []}
        for role, key, values in zip(data.column("role").to_pylist(), data.column("key"), data.column("values"), strict=True):
            x = values.as_py()
            if role in stats:
                one = np.frombuffer(x, np.int64)
                made[role].append(int(one[0]))
                stats[role] += one
                continue
            k, n = np.frombuffer(key.as_py(), np.uint64), 4 if role == FOLLOWED else 1
            kept[role].append((k, np.frombuffer(x, np.uint32 if len(x) == 4 * n * len(k) else np.uint64).astype(np.int64).reshape(n, -1)))
        out = {}
        for role, n in ((SEEN, 1), (CONTINUED, 1), (FOLLOWED, 4)):
            out[role] = _grouped(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in kept[role])]), *np.concatenate([np.zeros((n, 0), np.int64), *(x for _, x in kept[role])], 1))
        keys = np.unique(np.concatenate([k for k, _ in out.values()]))
        columns = []
        for names, values in out.values():
            for x in values:
                full = np.zeros(len(keys), np.int64)
                full[np.searchsorted(keys, names)] = x
                columns.append(full)
        small = [x.astype(np.uint32) if x.max(initial=0) < 2**32 else x for x in columns]
        write(folder, f"word-{shard}", key=keys, **dict(zip(("c", "cc", "total", "n1", "n2", "n3"), small, strict=True)))
        seen, cc = columns[:2]
        starts = int(seen[keys == START].sum())
        found = [*stats[THREES][1:].tolist(), *stats[TWOS][1:].tolist(), *(int((cc == k).sum()) for k in (1, 2, 3, 4)), int((cc >= 3).sum()), int((seen > 0).sum()) - (starts > 0), starts]
        return pa.table({"shard": [shard], "threes": pa.array([made[THREES]], pa.list_(pa.int64())), "twos": pa.array([made[TWOS]], pa.list_(pa.int64())), "x": pa.array([found], pa.list_(pa.int64()))})

    parts, pairs = [], []
    for k in range(rounds):
        lo, hi = plan.shards * k // rounds, plan.shards * (k + 1) // rounds

        def count(batches: Iterator[pa.RecordBatch], lo=lo, hi=hi) -> Iterator[pa.RecordBatch]:
            def fold(held: list) -> pa.RecordBatch:
                v, u, w, c = counted(*map(np.concatenate, zip(*held, strict=True)))
                to = plan.of(v, u)
                order = np.argsort(to, kind="stable")
                rows = [(int(to[order[a]]), 0, b"", packed(v[x], u[x], w[x], c[x])) for a, b in cuts(to[order]) for x in (order[a:b],)]
                return _table(rows).combine_chunks().to_batches()[0]

            held, n = [], 0
            for w, v, u in each(batches):
                shard = plan.of(v, u)
                on = np.flatnonzero((shard >= lo) & (shard < hi))
                held.append((v[on], u[on], w[on]))
                n += len(on)
                if n >= FOLD:
                    yield fold(held)
                    held, n = [], 0
                    trim()
            if n:
                yield fold(held)

        rows = staged(texts.mapInArrow(count, _NAMES).groupBy("shard").applyInArrow(merge, _NAMES), "lm-words")
        parts.append(rows.where(F.col("role") != PAIRS))
        if hot[lo:hi].any():
            pairs.append(rows.where(F.col("role") == PAIRS))
        drop_shuffles(spark)  # before the next round makes its own
    if pairs:  # of a hot bucket whose shards fall into several rounds too
        parts.append(staged(reduce(DataFrame.unionByName, pairs).groupBy("shard").applyInArrow(merge_pairs, _NAMES), "lm-pairs"))
    every = reduce(DataFrame.unionByName, parts)
    totals = every.groupBy("shard").applyInArrow(finish, "shard long, threes array<long>, twos array<long>, x array<long>").collect()
    model.by_word.seal([r.shard for r in totals])
    for files in (model.three, model.three_more, model.long):
        files.seal([x for r in totals for x in r.threes])
    for files in (model.two, model.two_more):
        files.seal([x for r in totals for x in r.twos])
    n = np.array([r.x for r in totals], np.int64).sum(0).tolist() if totals else [0] * 17
    d1 = discounts(n[10:14])
    model.tokens, model.pairs, model.texts = n[0], n[5], n[16]
    model.words = n[15] + (model.texts > 0)
    model.discounts = (d1, discounts(n[6:10]), discounts(n[1:5]))
    model.unseen = float(d1[1] * n[10] + d1[2] * n[11] + d1[3] * n[14]) / n[5] if n[5] else 1.0
    return model


def lm_score(docs: DataFrame, keep: list[str], model: Model, text_col: str = "text") -> DataFrame:
    """keep's columns of every row, n_tokens, n_known, base_score and score (log10 of the text's probability).

    A-Z is lower-cased; tokens are what ASCII white space separates and then one end, so null and
    empty texts have one token; a text of any length is read whole. Words are told apart by 64 bits of
    hashes, so two of 10^9 words fall together with a chance of 0.03; then n_known and scores of texts
    with them may be off. Bigrams and trigrams are told apart within their shard, by 36 bits for the
    context and 28 for the word: a context that was never seen passes for one that was in about
    0.002 % of cases. Repeated rows get a row each; an empty table gives none; keep may
    hold columns of any name; one named like a result gives way to it.
    """

    def run(texts: pa.Array) -> pa.Array:
        n, known, base, score = (np.zeros(len(texts), kind) for kind in (np.int64, np.int64, np.float64, np.float64))
        for i, j, data, bounds in chunks(texts):
            w, v, u, sizes = tokens(data, bounds)
            at = np.cumsum(sizes) - sizes
            n[i:j] = sizes
            for out, x in zip((known, base, score), model.score(w, v, u), strict=True):
                out[i:j] = np.add.reduceat(x.astype(out.dtype), at)
        return pa.StructArray.from_arrays([pa.array(x) for x in (n, known, base, score)], ["n_tokens", "n_known", "base_score", "score"])

    results = ("n_tokens", "n_known", "base_score", "score")
    found = mapped(docs.sparkSession, run, "n_tokens long, n_known long, base_score double, score double", F.col(f"`{text_col}`"))
    return beside(docs, keep, found, {x: x for x in results})


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 1


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = lm_score(docs, ["doc_id"], model)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
