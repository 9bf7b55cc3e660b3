import random
import re
import time

from quirelake.llm.decontaminate import contamination


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    out = []
    for d, text in docs:
        words, hit, found = tokens(text), set(), set()
        for item, t in items:
            w = tokens(t)
            n = min(10, len(w))
            for q in range(len(w) - n + 1) if n else ():
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[q : q + n]:
                        hit |= set(range(p, p + n))
                        if item is not None:
                            found.add(str(item))
        out.append((d, len(words), sorted(hit), sorted(found)))
    return sorted(out, key=repr)


def check(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, _row string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = contamination(d, b, ["doc_id"], **more).collect()
    got = sorted(((r.doc_id, r._n_words, [x for a, z in zip(r._starts, r._ends) for x in range(a, z)], r._items) for r in rows), key=repr)
    assert got == brute(docs, items)


def made(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["ab", "Ça", "7", "o", "zed", "né", "q"]) + r.choice(["", "1", "x"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 9, 10, 11, 25])))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 40)))]
        for _ in range(r.randint(0, 3)):
            w = r.choice(items)[1].split()
            a = r.randint(0, len(w) - 1)
            parts.append(r.choice([" ", ", ", "\n"]).join(w[a : a + r.randint(1, 20)]).upper().replace("É", "é"))
            parts.append(" ".join(word() for _ in range(r.randint(0, 9))))
        docs.append((i, "-".join(parts)))
    return docs, items


def test_against_brute_force(spark):
    for seed in (1, 2):
        check(spark, *made(seed))


def test_blocks_of_a_large_benchmark(spark):
    check(spark, *made(3), block_bytes=300)


def test_edges(spark):
    long = " ".join(str(i % 97) for i in range(30000))
    docs = [(1, None), (2, ""), (3, "!!"), (None, "one two three"), (4, "one two three"), (4, "one two three"), (5, long)]
    check(spark, docs, [(1, "Two three"), (1, "one"), (None, "three"), (2, None), (3, "..."), (4, " ".join(str(i) for i in range(20, 35)))])
    check(spark, docs[:-1], [])
    check(spark, [], [(1, "a b")])


def test_repeated_words_end_soon(spark):
    began = time.time()
    frame = spark.createDataFrame([(1, "la " * 20000), (2, "lo li " * 9000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "la " * 1000), (2, "li lo " * 400)], "item_id long, text string")
    rows = contamination(frame, items, ["doc_id"]).orderBy("doc_id").collect()
    assert [(r._starts, r._ends, r._items) for r in rows] == [([0], [20000], ["1"]), ([0], [18000], ["2"])]
    assert time.time() - began < 60


def test_ties_against_brute_force(spark):
    r = random.Random(9)
    words = lambda n: " ".join(r.choice("aab") for _ in range(n))
    check(spark, [(i, words(r.randint(0, 60))) for i in range(40)], [(i, words(r.choice([2, 9, 10, 14, 40]))) for i in range(8)])


def test_columns_with_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a b", "x", 1)], "doc_id long, text string, _starts string, spans int")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for more in ({}, {"block_bytes": 1}):
        got = contamination(frame, items.union(spark.createDataFrame([(2, "q")], items.schema)), frame.columns, **more)
        assert got.columns == ["doc_id", "text", "spans", "_n_words", "_starts", "_ends", "_items"] and got.first()._starts == [0]
