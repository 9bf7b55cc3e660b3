"""Near-dedup by similarity of shingle sets: SimHash fingerprints find candidates, the sets themselves confirm them.

Fingerprints are those of simhash.set_print, 256 bits of each set. Of two sets with Jaccard similarity
0.8 each bit differs with a chance of 0.16 at most (0.19 for 4 shingles within 5), so the
fingerprints are over RADIUS bits apart, or share no table of simhash.near_groups, with a chance of
0.000004 at most. More similar sets are closer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import small_batches, staged
from .simhash import BUCKET, FEW, RADIUS, near_groups, set_print
from .words import SPACED, Words, chunks, grams, mixed

#: Words of a shingle, least similarity of near copies in percent.
WORDS, PERCENT = 5, 80
#: Texts of one group that a task holds, or compares with one text; more are dealt into cells.
CELL = 4096


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its shingles; one shingle below `words` words, none without words."""
    for _, _, data, bounds in chunks(column):
        found = Words(data, bounds, SPACED)
        every, ends = grams(found.hash, words), np.cumsum(found.counts)
        for a, b in zip((ends - found.counts).tolist(), ends.tolist(), strict=True):
            yield np.unique(every[a : b - words + 1] if b - a >= words else grams(found.hash[a:b], b - a) if b > a else every[:0])


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _links(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def group_links(ids: list[int], roots: list[int], held: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """Links between members with different roots; every two roots that some link joins are joined.

    Every such link has an end outside the commonest root, so only those members are compared.
    """
    a, b, root = [], [], np.array(roots)
    names, counts = np.unique(root, return_counts=True)
    sizes = np.array([len(x) for x in held])
    ends = np.cumsum(sizes)
    _, shingle, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    # the members that have each shingle, one shingle after the other
    of, first = np.repeat(np.arange(len(held)), sizes)[shingle.argsort(kind="stable")], np.cumsum(n) - n
    for i in np.flatnonzero(root != names[counts.argmax()]).tolist():
        mine = shingle[ends[i] - sizes[i] : ends[i]]
        mine = mine[n[mine] > 1]
        many = n[mine]
        both = np.bincount(of[np.repeat(first[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(held))
        for j in np.flatnonzero((100 * both >= percent * (sizes + sizes[i] - both)) & (root != root[i])).tolist():
            if root[i] != root[j]:
                a.append(ids[i]), b.append(ids[j])
                root[root == root[j]] = root[i]
    return a, b


def _star_links(met: DataFrame, texts: DataFrame, words: int, percent: int, cell: int) -> DataFrame:
    """Links of members to the smallest one of their group, where the fingerprints are near."""
    pairs = met.where("near AND fp <> hub").select("hub", "fp").distinct()
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("hub")) / cell).cast("long")
    pairs = staged(pairs.select("hub", "fp", F.pmod(F.xxhash64("fp"), parts).alias("cell")), "pairs")
    hubs = pairs.select("hub", F.col("hub").alias("fp"), "cell").distinct()
    rows = pairs.unionByName(hubs).join(texts, "fp").select("hub", "cell", "fp", "text").repartition("hub", "cell").sortWithinPartitions("hub", "cell", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, fp, found in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(3), words), strict=True):
                if fp == hub:  # comes first
                    of = found
                elif alike(of, found, percent):
                    a.append(hub), b.append(fp)
            yield _links(a, b)

    return rows.mapInArrow(run, "a long, b long")


def _cross_links(met: DataFrame, roots: DataFrame, texts: DataFrame, words: int, percent: int, cell: int) -> DataFrame:
    """Links between members of one group that have different roots so far; groups of the same members are one."""
    members = met.join(roots, met["fp"] == roots["node"], "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.expr("bit_xor(xxhash64(fp))").alias("x"))
    groups = groups.where("n > 2 AND low < high").groupBy("n", "low", "high", "x").agg(F.min("key").alias("key"))
    parts = F.when(F.col("n") > cell, F.ceil(F.col("n") / (cell // 2)).cast("long")).otherwise(F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("fp"), F.col("parts"))
    # every two chunks meet in a cell of their own
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda o: F.least(mine, o) * F.col("parts") + F.greatest(mine, o))
    dealt = members.join(groups.select("key", parts.alias("parts")), "key").select("key", "fp", "root", F.explode(cells).alias("cell"))
    rows = dealt.join(texts, "fp").select("key", "cell", "fp", "root", "text").repartition("key", "cell").sortWithinPartitions("key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, roots, held = None, [], [], []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            for key, part, fp, root, found in zip(*columns, shingle_sets(batch.column(4), words), strict=True):
                if (key, part) != at:
                    if len(ids) > 1:
                        yield _links(*group_links(ids, roots, held, percent))
                    at, ids, roots, held = (key, part), [], [], []
                ids.append(fp), roots.append(root), held.append(found)
        if len(ids) > 1:
            yield _links(*group_links(ids, roots, held, percent))

    return rows.mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, cell: int = CELL, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id and component_id, the smallest id that links can reach.

    Two texts link if their sets of shingles of `words` words have a Jaccard similarity of
    `percent` or more. A-Z is lower-cased; words are what ASCII white space separates. Null texts
    and texts without a word link with each other. Texts with equal sets are one node, however many
    they are. Null ids take part; a component of null ids only has a null component_id.

    Candidates are the groups whose fingerprints link within `radius` bits. The sets near the smallest
    one of a group are compared with it first; only where that leaves a group in more than one component
    are its sets compared with each other. RADIUS and the tables are made for 80 percent or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bits, few = np.zeros(batch.num_rows, np.uint64), [], np.zeros(batch.num_rows, bool)
            for k, found in enumerate(shingle_sets(batch.column(1), words)):
                if len(found):
                    prints[k] = mixed(mixed(found).sum(keepdims=True))[0] | np.uint64(1)
                    few[k] = len(found) <= FEW
                bits.append(set_print(found).view(np.int64) if len(found) else found.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints.view(np.int64)), pa.array(bits, pa.list_(pa.int64())), pa.array(few)], [id_col, "sum", "fp", "bits", "few"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    text = docs.select(id_col, text_col, F.xxhash64(text_col).alias("sum"))
    prints = staged(text.mapInArrow(run, f"{id_col} {kind}, sum long, fp long, bits array<long>, few boolean"), "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("first"), F.min_by(F.struct("sum", "bits", "few"), "sum").alias("x")).select("fp", "first", "x.*"), "nodes")
    met = near_groups(nodes.where(F.size("bits") > 0), radius, bucket)
    needed = nodes.join(met.select("fp").distinct(), "fp").select("fp", "sum")
    texts = staged(docs.select(F.xxhash64(text_col).alias("sum"), F.col(text_col).alias("text")).join(needed, "sum").groupBy("fp").agg(F.first("text").alias("text")), "texts")
    found = staged(_star_links(met, texts, words, percent, cell), "stars")
    found = found.unionByName(staged(_cross_links(met, components(found), texts, words, percent, cell), "crossed"))
    roots = components(found)
    of = staged(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "roots")
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(of.join(ids, "root").select("fp", "component_id"), "fp").select(id_col, "component_id")
