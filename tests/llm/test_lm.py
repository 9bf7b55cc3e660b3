import math
import random
from collections import Counter

import numpy as np
import pytest

from quirelake.llm import lm as M


def tokens(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*lower.encode().split(), "end"]


class Brute:
    def __init__(self, texts):
        self.c, self.threes = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            self.threes.update(zip(["start", "start", *w], ["start", *w], w))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter((v, w) for _, v, w in self.threes)  # in how many contexts
        self.cc = Counter(w for _, w in self.pairs)
        self.after, self.behind = {}, {}
        for (v, _), n in self.pairs.items():
            self.after.setdefault(v, []).append(n)
        for (u, v, _), n in self.threes.items():
            self.behind.setdefault((u, v), []).append(n)
        count = lambda x: [sum(n == k for n in x.values()) for k in (1, 2, 3, 4)]
        self.d1, self.d2, self.d3 = M.discounts(count(self.cc)), M.discounts(count(self.pairs)), M.discounts(count(self.threes))

    def p(self, w, v, u):
        types = len(self.pairs)
        rest = sum(self.d1[min(n, 3)] for n in self.cc.values()) / types if types else 1.0
        p = (max(self.cc[w] - self.d1[min(self.cc[w], 3)], 0) / types if types else 0) + rest / (self.v + 1)
        for held, n, d in ((self.after.get(v), self.pairs[v, w], self.d2), (self.behind.get((u, v)), self.threes[u, v, w], self.d3)):
            if held:
                p = max(n - d[min(n, 3)], 0) / sum(held) + sum(d[min(x, 3)] for x in held) / sum(held) * p
        return p

    def row(self, text):
        w = tokens(text)
        base = sum(math.log10((self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), base, sum(math.log10(self.p(x, y, z)) for x, y, z in zip(w, ["start", *w], ["start", "start", *w]))


def made(seed, n=80):
    r = random.Random(seed)
    return [" ".join(r.choice(["the", "Of", "né", "x" + str(int(r.paretovariate(0.7))), "y\n"]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def compare(spark, train, score, **more):
    brute = Brute(train)
    model = M.train(spark.createDataFrame([(t, 1) for t in train], "text string, shard int"), **more)
    assert (model.tokens, model.words) == (brute.n, brute.v)
    got = M.lm_score(spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(score)], "id long, text string, score double"), ["id"], model).collect()
    assert len(got) == len(score)
    for r in got:
        want = brute.row(score[r.id])
        assert (r.n_tokens, r.n_known) == want[:2]
        assert r.base_score == pytest.approx(want[2], rel=1e-9) and r.score == pytest.approx(want[3], rel=1e-9)
    return brute


def test_against_brute_force(spark, monkeypatch):
    brute = compare(spark, made(1), [*made(2), None, "", "unknown words only", "the the the"])
    for v, u in ((b"the", b"the"), (b"the", b"never"), ("start", "start"), (b"never", b"the")):
        whole = sum(brute.p(w, v, u) for w in brute.c) + brute.p(b"?", v, u)
        assert whole == pytest.approx(1)


def test_folds_and_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "FOLD", 50)
    compare(spark, made(3), made(4), target=60, rounds=3)


def test_hot_words_have_several_shards(spark, monkeypatch):
    monkeypatch.setattr(M, "LONG", 3)
    monkeypatch.setattr(M, "MORE", 4)
    texts = ["the " * (i % 9) + f"the x{i} the y{i % 5} the" for i in range(150)]
    plan = M.planned(np.array([5, 900, 3, 0, 90]), 100)
    assert plan.first.tolist() == [0, 1, 10, 10, 10] and plan.parts.tolist() == [1, 9, 1, 1, 1] and plan.shards == 11 and plan.hot().sum() == 9
    compare(spark, texts, [*texts[::7], "the the nothing", None], target=70)


def test_rows_survive_packing():
    r = np.random.default_rng(3)
    v, u, w = (r.integers(0, 40, 3000).astype(np.uint64) for _ in range(3))
    rows = M.counted(v, u, w)
    assert all((a == b).all() for a, b in zip(rows, M.unpacked(M.packed(*rows))))
    assert Counter(zip(v.tolist(), u.tolist(), w.tolist())) == {(a, b, c): n for a, b, c, n in zip(*(x.tolist() for x in rows))}


def test_edges(spark):
    compare(spark, [None, "", None], ["", "a"])
    compare(spark, ["word " * 100000, "a", "a"], ["word " * 50000, "a", "a"])
    compare(spark, [], ["a b", None])


def test_discounts_stay_inside():
    for n in ([0, 0, 0, 0], [5, 0, 0, 0], [1, 100, 0, 3], [100, 40, 20, 10]):
        d = M.discounts(n)
        assert d[0] == 0 and all(0 < d[k] < k for k in (1, 2, 3))


def test_better_than_the_base(spark):
    rows = M.op10_lm_scoring(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert np.sum([r.score for r in held]) > np.sum([r.base_score for r in held])
