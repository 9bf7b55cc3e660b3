"""Benchmark decontamination by winnowing.

Every span of `window` words that a document shares with an item holds window - k + 1 common
k-grams, so both keep the least of these as a fingerprint. Fingerprints are joined, hits extended
both ways to maximal spans, and the words of the spans compared byte for byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import beside, fresh, mapped, staged, table, text_of
from .words import P, Words, buffers, chunks, grams, mixed, powers

#: Bytes of benchmark text in one broadcast index; more are taken in blocks, one pass each.
BLOCK_BYTES = 16 << 20
#: Hits that are extended at once.
HITS = 1 << 20
KIND = "n_words long, starts array<long>, ends array<long>, items array<string>"


def minima(g: np.ndarray, group: np.ndarray, last: np.ndarray, w: int, ties: bool) -> np.ndarray:
    """Positions of the least hash of every w consecutive ones of one group.

    Of equal ones all (ties), or the one whose place is least modulo w, so that equal hashes on end
    give every w-th place. Where one side takes all, the other needs only one of them.
    """
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(1, (w - 1).bit_length()))
    key = g >> bits
    if not ties:
        key = key << bits | (np.arange(len(g), dtype=np.uint64) % np.uint64(w))
    least = key[:n].copy()
    for j in range(1, w):
        np.minimum(least, key[j : j + n], out=least)
    whole, chosen = group[:n] == last[w - 1 : w - 1 + n], np.zeros(len(g), bool)
    for j in range(w):
        chosen[j : j + n] |= whole & (key[j : j + n] == least)
    return np.flatnonzero(chosen)


class Sequence:
    """Hashes of words, and of any run of them."""

    def __init__(self, h: np.ndarray):
        self.forward, self.back, self.total = powers(P, len(h)), powers(pow(P, -1, 1 << 64), len(h) + 1), np.zeros(len(h) + 1, np.uint64)
        np.cumsum((h | np.uint64(1)) * self.forward, out=self.total[1:])

    def of(self, a: np.ndarray, n: np.ndarray) -> np.ndarray:
        return mixed((self.total[a + n] - self.total[a]) * self.back[a])


def common(one: Sequence, p: np.ndarray, two: Sequence, q: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from p and q on (way 1) or before them (way -1) are equal, by halving."""
    n = np.zeros(len(p), np.int64)
    step = 1 << int(most.max(initial=0)).bit_length()
    while step := step >> 1:
        at = np.flatnonzero(n + step <= most)
        here = n[at] if way > 0 else -n[at] - step
        same = one.of(p[at] + here, np.full(len(at), step)) == two.of(q[at] + here, np.full(len(at), step))
        n[at[same]] += step
    return n


class Index:
    """Fingerprints of a block of items, sorted, and the items' words; items of equal texts are one."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int, k: int):
        self.window, self.k = window, k
        held: dict[str, set] = {}
        for x, text in zip(ids, texts, strict=True):
            held.setdefault(text or "", set()).add(x)
        self.ids = [sorted(x for x in found if x is not None) for found in held.values()]
        words = Words(*buffers(pa.array(list(held), pa.string())))
        self.hash, self.item = words.hash, words.doc
        self.ends = np.cumsum(words.counts)
        self.starts = self.ends - words.counts
        self.bytes = {}
        for h, word in zip(words.hash.tolist(), words.texts(0, len(words)), strict=True):
            if self.bytes.setdefault(h, word) != word:
                raise ValueError("two words of the benchmark share a 64-bit hash")
        sizes = words.counts[words.doc]
        g = grams(words.hash, k)
        at = minima(g, words.doc[: len(g)], words.doc[k - 1 :], window - k + 1, True)
        order = np.argsort(g[at], kind="stable")
        self.prints, self.at = g[at][order], at[order]
        self.short = {}
        for n in np.unique(sizes[sizes < window]).tolist():
            g = grams(words.hash, n)
            at = np.flatnonzero((words.doc[: len(g)] == words.doc[n - 1 :]) & (sizes[: len(g)] == n))
            order = np.argsort(g[at], kind="stable")
            self.short[n] = g[at][order], at[order]

    def pairs(self, prints: np.ndarray, at: np.ndarray, g: np.ndarray, where: np.ndarray):
        """Positions in the document and in the items with equal hashes, HITS at a time."""
        lo, hi = np.searchsorted(prints, g, "left"), np.searchsorted(prints, g, "right")
        found = np.flatnonzero(hi > lo)
        i, n = 0, np.cumsum((hi - lo)[found])
        while i < len(found):
            j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + HITS, "right")))
            f = found[i:j]
            size = (hi - lo)[f]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            yield np.repeat(where[f], size), at[np.repeat(lo[f], size) + step]
            i = j

    def spans(self, words: Words) -> np.ndarray:
        """Rows (first word, word after the last, item) of the maximal matches in a chunk of documents."""
        found, ends = [np.zeros((0, 3), np.int64)], np.cumsum(words.counts)
        starts = ends - words.counts
        g = grams(words.hash, self.k)
        at = minima(g, words.doc[: len(g)], words.doc[self.k - 1 :], self.window - self.k + 1, False) if len(self.prints) else np.zeros(0, np.int64)
        here = there = None
        for p, q in self.pairs(self.prints, self.at, g[at], at):
            if here is None:
                here, there = Sequence(words.hash), Sequence(self.hash)
            doc, item = words.doc[p], self.item[q]
            left = common(here, p, there, q, np.minimum(p - starts[doc], q - self.starts[item]), -1)
            right = common(here, p, there, q, np.minimum(ends[doc] - p, self.ends[item] - q), 1)
            long = left + right >= self.window
            found.append(np.unique(np.stack([p - left, p + right, q - left], 1)[long], axis=0))
        for n, (prints, where) in self.short.items():
            g = grams(words.hash, n)
            at = np.flatnonzero(words.doc[: len(g)] == words.doc[n - 1 :])
            for p, q in self.pairs(prints, where, g[at], at):
                found.append(np.stack([p, p + n, q], 1))
        found = np.unique(np.concatenate(found), axis=0)
        if not len(found):
            return found
        covered = np.zeros(len(words) + 1, np.int32)
        np.add.at(covered, found[:, 0], 1)
        np.add.at(covered, found[:, 1], -1)
        inside = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        spoilt = [i for i in inside.tolist() if self.bytes.get(int(words.hash[i])) != words.data[words.starts[i] : words.ends[i]].tobytes()]
        if spoilt:  # a word that only shares a hash with one of the items; no other word gets this one's
            words.hash[spoilt] = np.uint64(0x9E3779B97F4A7C15) * (np.array(spoilt, np.uint64) + np.uint64(1)) | np.uint64(1)
            return self.spans(words)
        good = [np.array_equal(words.hash[a:b], self.hash[z : z + b - a]) for a, b, z in found.tolist()]
        found = found[np.array(good, bool)]
        found[:, 2] = self.item[found[:, 2]]
        return found

    def hits(self, texts: pa.Array) -> pa.Array:
        """Of each text its number of words, the merged spans of hit words, and the items."""
        counts, starts, ends, items = [], [], [], []
        for i, j, data, bounds in chunks(texts):
            words = Words(data, bounds)
            spans, of = {}, {}
            first_word = np.cumsum(words.counts) - words.counts
            for a, b, item in self.spans(words).tolist():
                d = int(words.doc[a])
                mine = spans.setdefault(d, [])
                a, b = a - int(first_word[d]), b - int(first_word[d])
                if mine and a <= mine[-1][1]:  # rows are sorted
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
                of.setdefault(d, set()).update(self.ids[item])
            counts.append(words.counts)
            for r in range(j - i):
                starts.append([a for a, _ in spans.get(r, ())]), ends.append([b for _, b in spans.get(r, ())])
                items.append(sorted(of.get(r, ())))
        longs = pa.list_(pa.int64())
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *counts])), pa.array(starts, longs), pa.array(ends, longs), pa.array(items, pa.list_(pa.string()))], ["n_words", "starts", "ends", "items"])


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch made one."""
    last = lambda z: F.element_at(z, -1)
    joined = lambda z, x: F.concat(F.slice(z, 1, F.size(z) - 1), F.array(F.struct(last(z)["a"].alias("a"), F.greatest(last(z)["b"], x["b"]).alias("b"))))
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    return F.aggregate(F.array_sort(spans), empty, lambda z, x: F.when((F.size(z) > 0) & (F.try_element_at(z, F.lit(-1))["b"] >= x["a"]), joined(z, x)).otherwise(F.concat(z, F.array(x))))


def marked(docs: DataFrame, items: DataFrame, name: str, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column `name`: a struct of n_words, starts and ends (words of merged hit spans) and items (ids, sorted).

    The benchmark is measured first. Up to block_bytes it is one broadcast index, and documents
    are neither shuffled nor written. A larger one is dealt into blocks of that size: one after the
    other is broadcast, its hits are written by the text's MD5 and SHA-256, and the broadcast is
    given up again; in the end texts meet their hits.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_id).cast("string").alias("id"), text_of(item_text).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))

    def index(block: int):
        mine = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        found = mine.collect()  # at most about block_bytes
        return spark.sparkContext.broadcast(Index([r.id for r in found], [r.text for r in found], window, k))

    def of(sent, text: Column) -> Column:
        return mapped(spark, lambda x: sent.value.hits(x), KIND, text)

    if blocks == 1:
        return docs.withColumn(name, of(index(0), F.col(text_col)))
    rows, parts = docs.select(text_of(text_col).alias("text")).select(F.md5("text").alias("h"), F.sha2("text", 256).alias("s"), "text"), []
    for block in range(blocks):
        sent = index(block)
        parts.append(staged(rows.select("h", "s", of(sent, F.col("text")).alias("x")).where(F.size("x.starts") > 0).distinct(), "hits"))
        sent.unpersist()
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    spans = F.flatten(F.collect_list(F.zip_with("x.starts", "x.ends", lambda a, b: F.struct(a.alias("a"), b.alias("b")))))
    every = every.groupBy("h", "s").agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("x.items")))).alias("items")).select("h", "s", _merged(F.col("spans")).alias("spans"), "items")
    none = spark.sparkContext.broadcast(Index([], [], window, k))
    longs = F.array().cast("array<long>")
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(text_of(text_col)).alias("h"), F.sha2(text_of(text_col), 256).alias("s")).join(every, ["h", "s"], "left")
    counted = both.withColumn("n", of(none, F.col("row").getField(text_col)).getField("n_words"))
    found = F.struct(F.col("n").alias("n_words"), F.coalesce("spans.a", longs).alias("starts"), F.coalesce("spans.b", longs).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return counted.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], found.alias(name))


def contamination(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """keep's columns of every row, _n_words, _starts and _ends (words of merged hit spans), _items (ids as strings, sorted).

    A-Z is lower-cased; words are runs of digits, letters and all that is not ASCII. A window is
    `window` consecutive words of an item, or the whole of a shorter item that has a word. Items
    without words match nothing; items with equal ids count once; an item with a null id marks
    words and is not listed. Null texts have no words; a text of any length is read whole, in time
    linear in its words but for the logarithm of an item's. Rows stay apart even with equal ids. An
    empty benchmark hits nothing. A kept column named like a result gives way to it.
    """
    name = fresh(docs.columns, "_found")
    found = marked(docs, items, name, text_col, item_id, item_text, window, k, block_bytes)
    return beside(found, keep, F.col(name), {"n_words": "_n_words", "starts": "_starts", "ends": "_ends", "items": "_items"})


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.aggregate(F.zip_with("_ends", "_starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_starts") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS MATERIALIZED (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
h AS MATERIALIZED (
  SELECT r, p, n, item_id FROM (
    SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS s
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n))
  JOIN g USING (n, s)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM h)) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
