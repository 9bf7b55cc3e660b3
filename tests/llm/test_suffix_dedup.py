import os
import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from quirelake.llm import suffix_dedup as X

DATA = "/root/testdata/sf0.01"


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            key = (d is not None, d or 0)
            first[s] = min(first.get(s, key), key)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < (d is not None, d or 0):
                gone[p : p + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), spans, sha256(kept).hexdigest()))
    return Counter(out)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, "x", b"y") for d, t in rows], "doc_id long, text string, shard string, _kept binary")
    got = X.suffix_dedup(frame, ["doc_id"], **more).collect()
    for r in got:
        assert len(r._kept) == r._n_bytes - sum(b - a for a, b in zip(r._starts, r._ends))
    return Counter((r.doc_id, r._n_bytes, sum(b - a for a, b in zip(r._starts, r._ends)), len(r._starts), sha256(r._kept).hexdigest()) for r in got)


def made(seed, n=80):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "né", "of", "zab", "q" + str(r.randint(0, 99))])
    passages = [" ".join(word() for _ in range(r.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(n):
        if rows and r.random() < 0.3:
            b = list(r.choice(rows)[1])
            for _ in range(r.randint(0, 4)):
                if b:
                    b[r.randrange(len(b))] = r.choice("xyé")
            text = "".join(b)
        else:
            text = " ".join(word() for _ in range(r.randint(0, 60)))
            for _ in range(r.randint(0, 2)):
                p = r.choice(passages)
                a = r.randint(0, len(p) // 2)
                at = r.randint(0, len(text))
                text = text[:at] + p[a : a + r.randint(30, 200)] + text[at:]
        rows.append((i, text))
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2, 3):
        rows = made(seed)
        assert run(spark, rows) == brute(rows)


def test_merged_blocks(spark):
    rows = made(4, 120)
    for parts in (1, 3):
        assert run(spark, rows, parts=parts) == brute(rows)


def test_anchors_with_many_segments(spark):
    rows = made(5, 120)
    for hot in (1, 3):
        assert run(spark, rows, hot=hot) == brute(rows)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(X, "CHUNK", 150)
    r = random.Random(6)
    rows = [(d, t + " ".join(str(r.randint(0, 30)) for _ in range(300)) + t) for d, t in made(6, 30)]
    assert run(spark, rows) == brute(rows)


def test_repetitive_texts(spark):
    rows = [(i, ("ab" * 100 if i % 2 else "a" * 130 + str(i)) + "c" * (i * 7)) for i in range(12)]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 50), (5, "x" * 50), (None, "x" * 51), (6, "né" * 30), (7, "é" + "né" * 30), (8, "".join(chr(97 + i * i % 26) for i in range(60000)))]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == Counter()


def test_interleave_refines_to_the_sorted_union():
    r = np.random.default_rng(3)
    texts = [np.concatenate([np.r_[r.integers(1, 4, r.integers(1, 30)), 0] for _ in range(9)]).astype(np.uint16) for _ in range(5)]
    whole = np.concatenate(texts)
    order, block = X.merged(texts, 6)
    assert sorted(order.tolist()) == list(range(len(whole)))
    prefix = lambda p: next((whole[p : p + n + 1].tolist() for n in range(6) if p + n >= len(whole) or whole[p + n] == 0), None) or whole[p : p + 6].tolist()
    plain = [(prefix(p), b) for p, b in zip(order.tolist(), block.tolist()) if 0 not in whole[p : p + 6].tolist() and p + 6 <= len(whole)]
    assert [x for x, _ in plain] == sorted(x for x, _ in plain)
    assert all((a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(plain, plain[1:]))
    one, _ = X.transform(texts[0], 6)
    assert Counter(one.tolist()) == Counter(texts[0].tolist())


def test_transforms_are_merged():
    """Records of several shards of documents meet in a merge of more than one transform."""
    seen, merged = [], X.merged
    r = np.random.default_rng(5)
    n = 200
    windows = r.integers(2, 12, n)
    size = windows + X.LENGTH - X.K - X.SIDE - 1
    symbols = r.integers(97, 99, size.sum()).astype(np.uint8)
    number, doc, left = np.sort(r.integers(0, 5, n)), r.integers(0, 60, n), np.minimum(r.integers(0, 12, n), size)
    try:
        X.merged = lambda texts, depth: seen.append(len(texts)) or merged(texts, depth)
        many = X.earlier(number, doc, windows, left, symbols, 16)
        one = X.earlier(number, doc, windows, left, symbols, 1)
    finally:
        X.merged = merged
    assert seen[0] > 8 and seen[1] == 1 and (many == one).all() and many.any()


def test_a_lost_file_is_an_error(spark):
    rows = made(7, 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = X.find(frame)
    for name in os.listdir(found.segments.folder):
        if name.startswith("segment-") and name.endswith("-key"):
            os.remove(f"{found.segments.folder}/{name}")
    with pytest.raises(Exception, match="FileNotFound"):
        X.suffix_dedup(frame, ["doc_id"], found=found).collect()


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(250).collect()]
    assert run(spark, rows) == brute(rows)
