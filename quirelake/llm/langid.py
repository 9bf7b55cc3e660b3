"""Language ID: multinomial logistic regression on TF-IDF of hashed character 1- to 3-grams.

Trained with follow-the-regularised-leader (proximal, per coordinate) and an elastic net, then
calibrated by a temperature on labelled documents that the weights have not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import beside, mapped, small_batches, table

#: Features are n-gram hashes of this many bits.
BITS = 15
#: Labelled documents that fit the classifier, about; shared out evenly among languages.
TRAIN_ROWS = 3000

_letter = np.full(0x110000, -1, np.int8)


def letters(text: str | None) -> np.ndarray:
    """Lower-cased code points; what lies between letters as one space, with a space at both ends. Empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    kind = _letter[codes]
    if (kind < 0).any():
        for c in np.unique(codes[kind < 0]).tolist():
            _letter[c] = chr(c).isalpha()
        kind = _letter[codes]
    if not kind.any():
        return np.zeros(0, np.uint64)
    out = np.full(len(codes) + 2, 32, np.uint64)
    out[1:-1] = np.where(kind > 0, codes, 32)
    gap = out == 32
    return out[~(gap & np.r_[False, gap[:-1]])]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and 1 + log of their counts."""
    c = letters(text)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0)
    two = c[:-1] << np.uint64(21) | c[1:]
    three = c[:-2] << np.uint64(42) | two[1:]
    top = np.uint64(64 - BITS)
    spread = np.uint64(0x9E3779B97F4A7C15)
    hashed = [((x + np.uint64(1)) * spread ^ (x >> np.uint64(21))) * spread >> top for x in (c, two, three)]
    count = np.bincount(np.concatenate(hashed).view(np.int64), minlength=1 << BITS)
    at = np.flatnonzero(count)
    return at, 1 + np.log(count[at])


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[at]
        return x @ self.weights[at] / (math.sqrt(float(x @ x)) or 1.0) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        at, tf = features(text)
        if not len(at) or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(at, tf) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.005, l2: float = 0.01) -> Model:
    """FTRL-proximal over the rows, every fifth of which is held back for the temperature."""
    langs = sorted({lang for _, _, lang in rows})
    model = Model(langs, idf, np.zeros((1 << BITS, len(langs))), np.zeros(len(langs)))
    if len(langs) < 2:
        return model
    z, n = np.zeros((len(idf) + 1, len(langs))), np.zeros((len(idf) + 1, len(langs)))

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((beta + np.sqrt(n)) / alpha + l2)

    held, seen = rows[::5], [r for k, r in enumerate(rows) if k % 5] or rows
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(seen)):
            at, tf, lang = seen[k]
            x = tf * idf[at]
            x = np.r_[x / (np.sqrt(x @ x) or 1.0), 1.0]
            at = np.r_[at, len(idf)]
            w = solve(z[at], n[at])
            p = softmax(x @ w)
            p[langs.index(lang)] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = solve(z, n)
    model.weights, model.bias = w[:-1], w[-1]
    logits = np.array([model.logits(at, tf) for at, tf, _ in held])
    truth = np.array([langs.index(lang) for _, _, lang in held])

    def loss(t: float) -> float:
        x = logits / t
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), truth]).mean())

    model.temperature = min((10 ** (e / 20) for e in range(-26, 27)), key=loss)
    return model


def _featured(docs: DataFrame, text_col: str, lang_col: str) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Features, their weights and the label of each row that has features, as views of Arrow buffers, in an order of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([t for _, t in found], pa.list_(pa.float32())), batch.column(1)], ["at", "tf", "lang"])

    table, out = docs.select(text_col, lang_col).mapInArrow(run, "at array<int>, tf array<float>, lang string").toArrow(), []
    for batch in table.to_batches():
        at, tf = batch.column(0), batch.column(1)
        bounds, ids, values = at.offsets.to_numpy(), at.values.to_numpy(), tf.values.to_numpy()
        shift = tf.offsets.to_numpy()[0] - bounds[0] if len(bounds) else 0
        out += [(ids[a:b], values[a + shift : b + shift], lang) for a, b, lang in zip(bounds[:-1].tolist(), bounds[1:].tolist(), batch.column(2).to_pylist(), strict=True) if b > a]
    return sorted(out, key=lambda r: (len(r[0]), r[2], r[0].tobytes(), r[1].tobytes()))


def _frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Document frequency of each feature over all docs, and their number. A task sends its totals only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for x in batch.column(0):
                total[features(x.as_py())[0]] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], rows])], ["at", "n"])

    found = docs.select(text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = found.column("at").to_numpy(), found.column("n").to_numpy()
    df = np.zeros(1 << BITS, np.int64)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the labelled rows of docs: document frequencies of all, weights of about train_rows.

    The rows that fit the weights are those whose hash of text and label falls under their
    language's share; rows with equal text and label are one there, so copies add nothing and the
    sample is the same at every run. Without labelled rows the model knows no language.
    """
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    place = F.xxhash64(text_col, lang_col)
    counts = {r[0]: r[1] for r in known.select(F.col(lang_col).alias("lang"), place.alias("h")).distinct().groupBy("lang").count().collect()}
    df, rows = _frequencies(known, text_col)
    idf = np.log((1 + rows) / (1 + df)) + 1
    if not counts:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    each = max(50, train_rows // len(counts))
    chance = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / n)))])
    share = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    sample = known.where(share < F.element_at(chance, F.col(lang_col))).select(text_col, lang_col).distinct()
    return fit(_featured(sample, text_col, lang_col), idf)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def predicted(model: Model, text: Column, spark: SparkSession) -> Column:
    """A struct of lang and score (the calibrated probability) for each text, which alone goes to Python."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(x.as_py()) for x in texts]
        return pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["lang", "score"])

    return mapped(spark, run, "lang string, score double", text)


def language_id(docs: DataFrame, keep: list[str], model: Model, text_col: str = "text") -> DataFrame:
    """keep's columns of every row, lang_pred and score (the calibrated probability, 0 to 1).

    Null texts and texts without a letter get `und` and 0; so does every text when the model knows
    no language. Repeated rows get equal results; whole texts are read, however long; an empty table
    gives no row. keep may hold columns of any name; one named like a result gives way to it.
    """
    return beside(docs, keep, predicted(model, F.col(text_col), docs.sparkSession), {"lang": "lang_pred", "score": "score"})


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = language_id(docs, ["doc_id"], model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
