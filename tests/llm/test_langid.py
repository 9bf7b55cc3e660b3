import math
from collections import Counter

import numpy as np

from quirelake.llm import langid as L

DATA = "/root/testdata/sf0.01"


def test_letters():
    assert "".join(map(chr, L.letters("Été,  12 là!").tolist())) == " été là "
    assert not len(L.letters("12 !?")) and not len(L.letters(None))


def test_features_count_every_gram():
    at, tf = L.features("Ab ab")
    s = " ab ab "
    grams = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    assert math.isclose(sum(np.exp(tf - 1)), sum(grams.values())) and len(at) <= len(grams)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.op8_language_id(spark, DATA).collect()
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.97


def test_edges(spark):
    made = "doc_id long, text string, lang string, _row string, score string"
    rows = [(i, f"the cat and the dog {i} were there" if i % 2 else f"der hund und die katze {i} waren da", "en" if i % 2 else "de", "x", "y") for i in range(60)]
    docs = spark.createDataFrame(rows, made)
    model = L.train(docs)
    odd = [(1, None), (2, ""), (3, "12 ?!"), (None, "the dog"), (4, "die katze und der hund " * 20000), (4, "die katze und der hund " * 20000)]
    frame = spark.createDataFrame([(d, t, None, "x", "y") for d, t in odd], made)
    got = L.language_id(frame, ["doc_id", "_row", "score"], model)
    assert got.columns == ["doc_id", "_row", "lang_pred", "score"]
    got = got.collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "de", "de"] and got[0].score == 0
    empty = spark.createDataFrame([], made)
    assert L.language_id(empty, ["doc_id"], L.train(empty)).collect() == []
    assert {r.lang_pred for r in L.language_id(docs, ["doc_id"], L.train(empty)).collect()} == {"und"}


def test_copies_do_not_fill_the_sample(spark):
    from pyspark.sql import functions as F

    made = "text string, lang string"
    place = F.pmod(F.xxhash64("text", F.lit("en")), F.lit(1 << 30)) / float(1 << 30)
    common = spark.range(4000).select(F.concat(F.lit("the cat and the dog "), F.col("id").cast("string")).alias("text")).where(place < 0.01).first()[0]
    words = {"en": ("the", "cat", "dog", "were", "there"), "de": ("der", "hund", "und", "die", "katze")}
    rows = [(common, "en")] * 3000 + [(" ".join(words[k][(i // 5**j) % 5] for j in range(4)), k) for i in range(300) for k in ("en", "de")]
    docs = spark.createDataFrame(rows, made)
    one = L.train(docs.coalesce(1), train_rows=100)
    two = L.train(docs.repartition(7), train_rows=100)
    assert one.predict("der hund und die katze")[0] == "de" and one.predict("the cat there")[0] == "en"
    assert [one.predict(t) for t, _ in rows[2990:3050]] == [two.predict(t) for t, _ in rows[2990:3050]]


def test_steps_and_temperature_against_plain_formulas():
    """FTRL-proximal for one coordinate at a time, and the temperature by a fine search."""
    r = np.random.default_rng(2)
    idf = np.ones(1 << L.BITS)
    rows = []
    for i in range(40):
        at = np.unique(r.integers(0, 6, 3))
        rows.append((at, np.ones(len(at)), "ab"[int(at[0] > 2)]))
    got = L.fit(rows, idf, epochs=2)
    z, n, order = {}, {}, np.random.default_rng(0)

    def weight(key):
        x, y = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(x) <= 0.005 else -(x - math.copysign(0.005, x)) / ((1.0 + math.sqrt(y)) / 1.0 + 0.01)

    seen = [x for k, x in enumerate(rows) if k % 5]
    for _ in range(2):
        for k in order.permutation(len(seen)):
            at, _, lang = seen[k]
            x = {**{int(a): 1 / math.sqrt(len(at)) for a in at}, -1: 1.0}
            w = {(a, c): weight((a, c)) for a in x for c in "ab"}
            s = {c: math.exp(sum(v * w[a, c] for a, v in x.items())) for c in "ab"}
            for a, v in x.items():
                for c in "ab":
                    g = v * (s[c] / sum(s.values()) - (c == lang))
                    z[a, c] = z.get((a, c), 0.0) + g - (math.sqrt(n.get((a, c), 0.0) + g * g) - math.sqrt(n.get((a, c), 0.0))) * w[a, c]
                    n[a, c] = n.get((a, c), 0.0) + g * g
    for a in range(6):
        assert np.allclose(got.weights[a], [weight((a, "a")), weight((a, "b"))])
    assert np.allclose(got.bias, [weight((-1, "a")), weight((-1, "b"))])

    def loss(t):
        return -sum(math.log(L.softmax(got.logits(at, tf) / t)["ab".index(lang)]) for at, tf, lang in rows[::5])

    assert loss(got.temperature) <= min(loss(10 ** (e / 20)) for e in range(-26, 27)) + 1e-9
