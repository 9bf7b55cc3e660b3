"""SimHash near-dedup with bit-sliced comparison.

Fingerprints that differ in at most r of 64 bits agree in at least c of r + c blocks of bits, so
each one is dealt under every c blocks; the more fingerprints, the larger c. What meets under a key
is compared with its bit planes stored vertically: 64 fingerprints to a word, distances in
carry-save counters.

Sets of similarity 0.8 differ in too many of 64 bits for that, so they have fingerprints of 256 bits.
Those are dealt by some of their bits, in as many tables as it takes, and compared in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import drop_shuffles, small_batches, staged, table
from .words import Q, mixed

#: Fingerprints that one task compares with each other; larger groups are split into cells.
CELL = 4096
#: Split keys up to this number are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 100_000

#: Bits of the fingerprint of a set, and how many may differ.
BITS, RADIUS = 256, 80
#: Greatest chance that a bit differs between sets of similarity 0.8 or more: 4 shingles within 5, and all other sizes.
FEW, P_FEW, P_DIFFERS = 5, 0.1875, 0.1612
#: Chance that two such fingerprints share no table.
MISSED = 3e-6
#: Fingerprints of sets that one key has on average, most in one cell, tables dealt at once.
BUCKET, BUCKET_CELL, ROUND = 2048, 16384, 64

_SALTS = mixed(np.arange(1, BITS // 64 + 1, dtype=np.uint64))


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit majority of the shingles' XXH64; 0 without words, one shingle below `words` words."""
    found = (text or "").encode().lower().split()  # ASCII white space; bytes.lower() changes A-Z only
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    last = ends[min(words, len(found)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def set_print(found: np.ndarray) -> np.ndarray:
    """The majority of 256 bits of each hash of a set, as four words."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(found), 8192):
        h = mixed(found[k : k + 8192, None] ^ _SALTS)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def bits_of(prints: np.ndarray) -> np.ndarray:
    """One row of bits for each print; prints of several words are rows."""
    width = 8 * (prints.shape[1] if prints.ndim > 1 else 1)
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, width), axis=1, bitorder="little")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row i holds bit i of all prints, 64 prints to a word; the last word is padded with zeros."""
    n = -(-len(prints) // 64) * 64
    bits = bits_of(prints)
    out = np.zeros((bits.shape[1], n), np.uint8)
    out[:, : len(prints)] = bits.T
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def near_mask(planes: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """Of each query (row) the prints within radius, as boolean columns, with padding.

    Planes enter four at a time (16 if there are more than 64) through full adders into vertical
    counters of bit_length(radius) bits; a carry out of the top counter sticks. At every third
    time the queries for which every print has passed the radius are abandoned.
    """
    depth, step = max(1, radius.bit_length()), 4 if len(planes) <= 64 else 16
    shape = (len(queries), planes.shape[1])
    out, live = np.zeros(shape, np.uint64), np.arange(len(queries))
    counts, over = [np.zeros(shape, np.uint64) for _ in range(depth)], np.zeros(shape, np.uint64)
    flip = np.where(bits_of(queries) > 0, ~np.uint64(0), np.uint64(0))
    for k in range(0, len(planes), step):
        carries = [planes[i][None, :] ^ flip[:, i, None] for i in range(k, k + step)]
        for level in range(depth):
            held, up = counts[level], []
            for a, b in zip(carries[::2], [*carries[1::2], None], strict=False):
                half = held ^ a
                if b is None:
                    up.append(held & a)
                    held = half
                else:
                    up.append((held & a) | (half & b))
                    held = half ^ b
            counts[level], carries = held, up
        for c in carries:
            over |= c
        last = k + step >= len(planes)
        if last or (k // step % 3 == 2 and k + step > radius):
            beyond, equal = over.copy(), ~np.zeros_like(over)
            for level in reversed(range(depth)):
                if radius >> level & 1:
                    equal &= counts[level]
                else:
                    beyond |= equal & counts[level]
                    equal &= ~counts[level]
            keep = ~(beyond == ~np.uint64(0)).all(1)
            if not keep.all():
                live, flip, over, beyond = live[keep], flip[keep], over[keep], beyond[keep]
                counts = [c[keep] for c in counts]
                if not len(live):
                    break
    else:
        out[live] = ~beyond
    return np.unpackbits(out.view(np.uint8), axis=1, bitorder="little").astype(bool)


def group_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group of distinct prints: each reached print with its start.

    Breadth first: the frontier is compared with the prints not yet reached only.
    """
    rest, a, b = prints, [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        root = front[0]
        while len(front) and len(rest):
            near = near_mask(planes_of(rest), front[:32], radius)[:, : len(rest)].any(0)
            front, hit, rest = front[32:], rest[near], rest[~near]
            a.append(np.full(len(hit), root)), b.append(hit)
            front = np.concatenate([front, hit])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def sorted_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys. Small runs are compared at growing distance, all runs at once."""
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(cuts)
    a, b = [], []
    small = np.repeat(sizes <= 24, sizes)
    for lag in range(1, int(sizes[sizes <= 24].max(initial=1))):
        at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
        if len(at):
            near = near_mask(planes_of(prints[at] ^ prints[at + lag]), np.zeros(1, np.uint64), radius)[0, : len(at)]
            a.append(prints[at[near]]), b.append(prints[at[near] + lag])
    for k in np.flatnonzero(sizes > 24):
        x, y = group_links(prints[cuts[k] : cuts[k + 1]], radius)
        a.append(x), b.append(y)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), words, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], [id_col, "fp"])

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, fp long")


def blocks_that_agree(n: int, radius: int, cell: int) -> int:
    """So many that random fingerprints under one key stay well below a cell."""
    c = 2
    while n >> (64 * c // (c + radius)) > cell // 4 and c < 8:
        c += 1
    return c


def _in_cells(dealt: DataFrame, counts: DataFrame, cell: int) -> DataFrame:
    """Rows sorted by key and cell: a key with more than `cell` rows has chunks, and every two of them meet in a cell."""
    names = [c for c in dealt.columns if c != "key"]
    large = staged(counts.where(F.col("count") > cell).select("key", F.ceil(F.col("count") / (cell // 2)).cast("long").alias("parts")), "large")
    if many := large.count():
        dealt = dealt.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "key", "left")
        mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
        cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(mine, o) * F.col("parts") + F.greatest(mine, o))
        )
        dealt = dealt.select("key", *names, F.explode(cells).alias("cell"))
    else:
        dealt = dealt.withColumn("cell", F.lit(0).cast("long"))
    return dealt.select("key", "cell", *names).repartition("key", "cell").sortWithinPartitions("key", "cell")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of long columns, cut where the first two (key and cell) change only."""
    held: list[np.ndarray] = []  # of a group that may go on in the next batch
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns], 1)
        if len(rows) and held and (held[-1][-1, :2] != rows[0, :2]).any():
            yield np.concatenate(held)
            held = []
        if cut := int(np.flatnonzero((rows[:, :2] != rows[-1:, :2]).any(1)).max(initial=-1)) + 1:
            yield np.concatenate([*held, rows[:cut]])
            held, rows = [], rows[cut:]
        if len(rows):
            held.append(rows)
    if held:
        yield np.concatenate(held)


def links(prints: DataFrame, radius: int = 4, cell: int = CELL, agree: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp: a spanning forest of each compared group.

    Every two fingerprints within radius meet in some group, so the links connect exactly what is
    connected; copies are not expanded into pairs. A group above `cell` prints is dealt into chunks
    and every two chunks meet in a cell of their own, so no task holds more than two chunks.
    """
    agree = agree or blocks_that_agree(prints.count(), radius, cell)
    n = radius + agree
    edges = [round(64 * k / n) for k in range(n + 1)]
    fp = F.col("fp")

    def block(i: int):
        return F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))

    def key(k: int, chosen: tuple[int, ...]):
        found = block(chosen[0])
        for i in chosen[1:]:
            found = F.shiftleft(found, edges[i + 1] - edges[i]) + block(i)
        return F.lit(k) * F.lit(1 << 52) + found

    keys = [key(k, chosen) for k, chosen in enumerate(combinations(range(n), agree))]
    dealt = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    dealt = _in_cells(dealt, dealt.groupBy("key").count(), cell)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
            a, b = sorted_links(np.cumsum(new), np.ascontiguousarray(rows[:, 2]).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.select("key", "cell", "fp").mapInArrow(run, "a long, b long")


def tables_for(k: int, p: float) -> int:
    """So many tables with keys of k bits that fingerprints whose bits differ with chance p share one but for MISSED."""
    d = np.arange(RADIUS + 1)
    chance = np.exp([math.lgamma(BITS + 1) - math.lgamma(x + 1) - math.lgamma(BITS - x + 1) + x * math.log(p) + (BITS - x) * math.log(1 - p) for x in d])
    apart = 1 - np.prod([(BITS - d - j) / (BITS - j) for j in range(k)], axis=0) * np.ones(len(d))
    n = 1
    while (chance * apart**n).sum() > MISSED:
        n += 1
    return n


def key_bits(k: int) -> np.ndarray:
    """The places of each table's bits; the first tables are for all sets, the rest for those of few shingles."""
    r, n = np.random.default_rng(64), tables_for(k, P_FEW)
    return np.array([r.choice(BITS, k, replace=False) for _ in range(n)], np.int64).reshape(n, k)


def key_values(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of each print (row) its key in each table."""
    weights = np.int64(1) << np.arange(places.shape[1], dtype=np.int64)
    return bits_of(prints)[:, places] @ weights


def near_labels(prints: np.ndarray, radius: int) -> np.ndarray:
    """Of each print the place of the first one that it can reach by steps within radius."""
    planes, labels = planes_of(prints), np.arange(len(prints))
    for i in range(0, len(prints), 128):
        near = near_mask(planes[:, i // 64 :], prints[i : i + 128], radius)[:, : len(prints) - i]
        for q in np.flatnonzero(near.sum(1) > 1).tolist():
            found = labels[i:][near[q]]
            if (found != found[0]).any():
                labels[np.isin(labels, found)] = found.min()
    return labels


def near_groups(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, cell: int = BUCKET_CELL) -> DataFrame:
    """(key, fp, hub, near): groups of sets whose fingerprints link within radius, the smallest fp of each, and whether it is within radius.

    prints: fp, bits (the four words of set_print), few (whether the set has FEW shingles or less).
    Keys grow with the number of rows, so that one has about `bucket` of them; up to `bucket` rows have one
    key and lose nothing. A group is what links under one key, so it comes back from several tables. Tables
    are dealt in rounds, whose shuffle files are dropped.
    """
    spark, k = prints.sparkSession, max(0, -(-prints.count() // bucket) - 1).bit_length()
    places, usual = key_bits(k), tables_for(k, P_DIFFERS)
    words = [f"w{i}" for i in range(BITS // 64)]
    small_batches(spark)

    def keyed(batch: pa.RecordBatch, first: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        fp, few = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        found = batch.column(1).flatten().to_numpy().reshape(-1, BITS // 64)
        tables = np.arange(first, min(first + ROUND, len(places)))
        for i in range(0, len(fp), 1024):
            keys = key_values(found[i : i + 1024], places[tables]) + (tables << 40)
            row, at = np.nonzero((tables < usual) | few[i : i + 1024, None])
            yield keys[row, at], fp[i + row], found[i + row]

    def round_of(first: int) -> DataFrame:
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((2, 0), np.int64)  # keys and their counts in this task
            for batch in batches:
                parts = [held, *(np.stack(np.unique(keys, return_counts=True)) for keys, _, _ in keyed(batch, first))]
                keys, n = np.concatenate(parts, 1)
                names, at = np.unique(keys, return_inverse=True)
                held = np.stack([names, np.bincount(at, n, len(names)).astype(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "n"])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, fp, found in keyed(batch, first):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, fp, *found.T)], ["key", "fp", *words])

        def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _whole_groups(batches):
                cuts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1), True])
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if b - a < 2:
                        continue
                    rest = rows[a:b][rows[a:b, 2].argsort()]  # so that the first of a group is its hub
                    fp, found = rest[:, 2], rest[:, 3:].copy().view(np.uint64)
                    label = near_labels(found, radius)
                    many = np.bincount(label, minlength=b - a)[label] > 1
                    near = np.bitwise_count(found ^ found[label]).sum(1, dtype=np.int64) <= radius
                    name = mixed(mixed(rows[a, :1].view(np.uint64) * np.uint64(Q) + rows[a, 1:2].view(np.uint64)) + fp.copy().view(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (name[label], fp, fp[label], near)], ["key", "fp", "hub", "near"])

        rows = prints.select("fp", "bits", "few").where("few" if first >= usual else "true")
        counts = rows.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("count"))
        dealt = rows.mapInArrow(deal, ", ".join(f"{x} long" for x in ["key", "fp", *words]))
        return staged(_in_cells(dealt, counts, cell).mapInArrow(group, "key long, fp long, hub long, near boolean"), "groups")

    found = round_of(0)
    for first in range(ROUND, len(places), ROUND):
        drop_shuffles(spark)
        found = found.unionByName(round_of(first))
    return found


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id that can be reached).

    A-Z is lower-cased; words are what ASCII white space separates; shingles have `words` words.
    Null and empty texts, and texts of white space, have fingerprint zero and link with each other.
    Rows with the same fingerprint are one node, however many they are. Repeated ids fall into one
    component only if their fingerprints do. A text of any length is read whole. Null ids take part; a component of null ids only has a
    null component_id. Other columns of docs are ignored; an empty table gives no row.
    """
    prints = staged(fingerprints(docs, id_col, text_col, words, seed), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    found = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    found = staged(found, "roots")
    ids = found.groupBy("root").agg(F.min("first").alias("component_id"))
    of = staged(found.join(ids, "root").select("fp", "component_id"), "classes")
    return prints.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))
