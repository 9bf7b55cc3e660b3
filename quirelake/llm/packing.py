"""Packing documents into sequences by cutting-stock column generation.

A document is cut into full sequences and one remainder. The histogram of piece lengths is the
demand of a cutting-stock problem: a linear program over patterns, whose columns a knapsack
dynamic program prices. Rounded patterns are then filled with the ranked pieces of each length class.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import small_batches, staged, table
from .words import buffers

#: Tokens of a sequence, tokens by which a length class is rounded up, ranks kept apart within a class.
CAPACITY, WIDTH, BUCKETS = 2048, 8, 1024
#: The id that ends a document.
END = 1
#: Characters of text that are encoded at once, and of a text that is encoded twice to compare.
SLICE, PROBE = 1 << 20, 20_000
# Fixed value: how the byte-level vocabulary cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks_of(made: dict) -> dict[bytes, int] | None:
    """Bytes and id of each token of a byte-level vocabulary whose ids are the order of its merges; None of any other."""
    model, before = made.get("model") or {}, made.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or made.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return None
    if any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b >= 174]  # bytes written as their own character
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    added = {x["content"] for x in made.get("added_tokens") or ()}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    ids = [vocabulary.get(a + b, -1) for a, b in pairs]
    if sorted(ids) != ids or ids[:1] == [-1] or len(set(ids)) + 256 != len(vocabulary) or not all(c in byte for t in vocabulary for c in t):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items()}


class Encoder:
    """Token ids of texts as `tokenizers` gives them, as little-endian unsigned 32-bit bytes.

    The vocabulary file decides. If it is byte-level and its ids are the order of its merges, as in
    byte_bpe_50k.json, the same merges are run by `tiktoken`, which makes equal ids in a third of
    the time. Texts that hold an added token, texts on which its pattern fails (white space of
    about a million characters on end), and any other vocabulary go through `tokenizers` itself.
    One text of each call goes through both; on a difference, this call's and all later ones do without
    the quick way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.quick = Tokenizer.from_file(path), None
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as source:
            ranks = ranks_of(json.load(source))
        if ranks:
            import tiktoken

            self.quick = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or any(x in text for x in self.added):
            return self.plain(text)
        try:
            return self.quick.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return self.plain(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = [self.ids(text).astype("<u4").tobytes() for text in texts]
        k = next((k for k, text in enumerate(texts) if 0 < len(text) <= PROBE), None)
        if self.quick is not None and k is not None and self.plain(texts[k]).astype("<u4").tobytes() != out[k]:
            self.quick = None
            return [self.plain(text).astype("<u4").tobytes() for text in texts]
        return out


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, buckets: int = BUCKETS, with_ids: bool = False) -> DataFrame:
    """The pieces of every row: id, start, length, ids_crc32, doc_tokens, bucket, and ids if asked for.

    buckets deal the pieces of a task in turn; they only keep ranks apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encode, at = _encoders[vocabulary], TaskContext.get().partitionId() * 7919
        for batch in batches:
            column, i = batch.column(1), 0
            total = np.cumsum(np.diff(buffers(column)[1]))
            rows, starts, sizes, sums, totals, kept = [], [], [], [], [], []
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + SLICE, "right")))
                for r, ids in enumerate(encode([x or "" for x in column.slice(i, j - i).to_pylist()]), i):
                    ids += END.to_bytes(4, "little")
                    n = len(ids) // 4
                    for a in range(0, n, capacity):
                        part = ids[4 * a : 4 * (a + capacity)]
                        rows.append(r), starts.append(a), sizes.append(len(part) // 4), sums.append(zlib.crc32(part)), totals.append(n)
                        if with_ids:
                            kept.append(np.frombuffer(part, "<u4").astype(np.int32))
                i = j
            buckets_of = (at + np.arange(len(rows))) % buckets
            at += len(rows)
            arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals, buckets_of)]]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "start", "length", "ids_crc32", "doc_tokens", "bucket", *["ids"] * with_ids])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket long" + ", ids array<int>" * with_ids)


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most worth of any number of each size in capacity, and how many of each."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    by, value = sizes[order], worth[order]
    fits = np.searchsorted(by, np.arange(capacity + 1), "right")
    for w in range(1, capacity + 1):
        best[w], last[w] = best[w - 1], -1
        if n := fits[w]:
            gain = best[w - by[:n]] + value[:n]
            k = int(gain.argmax())
            if gain[k] > best[w] + 1e-12:
                best[w], last[w] = gain[k], order[k]
    count, w = np.zeros(len(sizes), np.int64), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            count[last[w]] += 1
            w -= sizes[last[w]]
    return float(best[capacity]), count


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """(pieces of each size, times) that meet the demand exactly.

    Revised simplex on the restricted master; stops when the bound that the duals give is within gap.
    Rounded down patterns leave at most what one use of each holds; that is filled largest first.
    """
    m = len(sizes)
    if not m:
        return []
    columns = np.diag(capacity // sizes)
    inverse = np.diag(1.0 / (capacity // sizes))
    x = inverse @ demand
    for _ in range(rounds):
        duals = inverse.sum(0)
        value, column = knapsack(sizes, duals, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(direction > 1e-9, x / direction, np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * direction, 0)
        x[out] = step
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        columns[:, out] = column
    times = np.floor(x + 1e-9).astype(np.int64)
    left = demand - columns @ times
    while (left < 0).any():  # rounding errors of the inverse
        k = int(np.flatnonzero(left < 0)[0])
        p = int(np.flatnonzero((columns[k] > 0) & (times > 0))[0])
        times[p] -= 1
        left = demand - columns @ times
    found = [(columns[:, p].copy(), int(times[p])) for p in range(m) if times[p]]
    order = np.argsort(-sizes)
    while left.any():
        room, column = capacity, np.zeros(m, np.int64)
        for k in order:
            column[k] = min(left[k], room // sizes[k])
            room -= column[k] * sizes[k]
        n = int(np.min(left[column > 0] // column[column > 0]))
        found.append((column, n))
        left = left - n * column
    return found


@dataclass
class Plan:
    """Of each class: ranks at which its share of a pattern begins, the pattern's first sequence, pieces and slot in it."""

    width: int
    offsets: np.ndarray  # of a class and bucket, ranks before it
    starts: dict[int, np.ndarray]
    base: dict[int, np.ndarray]
    each: dict[int, np.ndarray]
    slot: dict[int, np.ndarray]

    def place(self, cls: np.ndarray, bucket: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, slot = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
        rank = rank + self.offsets[cls, bucket]
        for c in np.unique(cls).tolist():
            at = np.flatnonzero(cls == c)
            k = np.searchsorted(self.starts[c], rank[at], "right") - 1
            over = rank[at] - self.starts[c][k]
            sequence[at] = self.base[c][k] + over // self.each[c][k]
            slot[at] = self.slot[c][k] + over % self.each[c][k]
        return sequence, slot


def plan(cls: np.ndarray, bucket: np.ndarray, n: np.ndarray, capacity: int = CAPACITY, width: int = WIDTH, buckets: int = BUCKETS) -> Plan:
    """The plan for n pieces in each class and bucket; a piece of class c has up to c * width tokens."""
    units = capacity // width
    held = np.zeros((units + 1, buckets), np.int64)
    held[cls, bucket] = n
    demand = held.sum(1)
    sizes = np.flatnonzero(demand)
    out = {c: ([], [], [], []) for c in sizes.tolist()}
    used, first = dict.fromkeys(sizes.tolist(), 0), 0
    for column, times in patterns(sizes, demand[sizes], units):
        slot = 0
        for c, k in zip(sizes.tolist(), column.tolist(), strict=True):
            if k:
                for x, v in zip(out[c], (used[c], first, k, slot), strict=True):
                    x.append(v)
                used[c] += k * times
                slot += k
        first += times
    return Plan(width, np.cumsum(held, 1) - held, *[{c: np.array(x[k], np.int64) for c, x in out.items()} for k in range(4)])


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Null and empty texts are one piece that holds the end id; a text of any length is encoded whole. A row is cut only where it exceeds a
    sequence; every id lies in one piece. Rows with equal ids or texts are packed each on its own.
    An empty table gives no row; other columns of docs are ignored.

    The driver gets one count for each class and bucket, as many at any size, and sends back the
    plan. Ranks are taken within a class and bucket, so no class meets in one task.
    """
    found = staged(pieces(docs, vocabulary, id_col, text_col, capacity, with_ids=with_ids).withColumn("class", F.ceil(F.col("length") / width).cast("long")), "pieces")
    counts = found.groupBy("class", "bucket").count().toArrow()
    cls, bucket, n = (counts.column(c).to_numpy() for c in ("class", "bucket", "count"))
    ready = docs.sparkSession.sparkContext.broadcast(plan(cls, bucket, n, capacity, width))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("class", "bucket").orderBy(id_col, "start", "ids_crc32", "length")).cast("long") - 1)
    columns = [c for c in found.columns if c not in ("class", "bucket")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, slot = ready.value.place(*[batch.column(c).to_numpy() for c in ("class", "bucket", "rank")])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(sequence), pa.array(slot)], [*columns, "sequence_id", "slot"])

    schema = found.select(*columns, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("slot")).schema
    placed = ranked.mapInArrow(run, schema)
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("slot")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
