import random

import numpy as np
import pyarrow as pa

import corpus_pipeline as P
from quirelake.llm import near_dedup as N

DATA = "/root/testdata/sf0.01"


def shingles(text):
    found = (text or "").encode().lower().split()
    return frozenset(b" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))) if found else frozenset()


def brute(rows):
    held, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = held[i], held[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def check(spark, rows, **more):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in N.near_dedup(frame, **more).collect()), key=repr) == brute(rows)


def test_against_brute_force(spark):
    r = random.Random(3)
    rows, base = [], [[f"w{r.randint(0, 5000)}" for _ in range(r.randint(1, 120))] for _ in range(12)]
    for i in range(160):
        words = r.choice(base)
        for _ in range(r.choice((0, 1, 1, 2, 3))):  # steps away from a copy make chains
            words = list(words)
            words[r.randrange(len(words))] = f"n{r.randint(0, 9)}"
        if r.random() < 0.3:
            base.append(words)
        rows.append((i, " ".join(words)))
    rows += [(None, rows[3][1]), (900, None), (901, ""), (902, " \n"), (903, "ONE two"), (904, "one  TWO"), (905, "one two three"), (None, "alone here")]
    check(spark, rows)
    check(spark, rows, cell=4)
    check(spark, [])


def test_chain_whose_smallest_member_is_far_from_some():
    words = [f"w{i}" for i in range(60)]
    held = list(N.shingle_sets(pa.array([" ".join(words[k : k + 50]) for k in (0, 5, 10)])))
    assert N.alike(held[0], held[1], 80) and N.alike(held[1], held[2], 80) and not N.alike(held[0], held[2], 80)
    a, b = N.group_links([7, 8, 9], [7, 8, 9], held, 80)
    assert {frozenset(x) for x in zip(a, b)} == {frozenset((7, 8)), frozenset((8, 9))}
    assert all(np.array_equal(np.unique(x), x) for x in held)


def test_stage_finds_copies_of_similarity_0_8(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in P.near_copies(spark, docs, DATA).collect()}
    assert kept == {d for d, root in brute(rows) if d == root}
    assert 255 not in kept and 770 not in kept  # 7 bits of 64 from docs 1 and 643


def test_candidates_come_from_fingerprints(spark):
    """At radius 0 only equal fingerprints can link; more keys than one lose no link."""
    r = random.Random(8)
    words = [[f"w{r.randint(0, 10**6)}" for _ in range(60)] for _ in range(40)]
    rows = [(2 * i + k, " ".join([*x[: 59 - k], f"end{k}"])) for i, x in enumerate(words) for k in (0, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x.doc_id, x.component_id) for x in N.near_dedup(frame, radius=0).collect()} == {(d, d) for d, _ in rows}
    assert {(x.doc_id, x.component_id) for x in N.near_dedup(frame, bucket=20).collect()} == {(d, d - d % 2) for d, _ in rows}
