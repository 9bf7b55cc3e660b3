from pyspark.sql import functions as F

from quirelake.llm.exact_dedup import exact_dedup
from hashlib import sha256

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "A"), (5, "A"), (None, "a"), (None, "n"), (6, "x" * 300000), (7, "x" * 300000), (8, "x" * 299999 + "y")]


def brute(rows, best):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        keep = best([x for x in groups[t or ""] if x is not None], default=None)
        out.append((d, keep, len(groups[t or ""]), d == keep, sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(d, t, "k", b"h") for d, t in rows], "doc_id long, text string, keep_id string, _x binary")
    return sorted((tuple(x) for x in exact_dedup(frame, **more).collect()), key=repr)


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS, min)
    assert run(spark, ROWS, keep="max") == brute(ROWS, max)


def test_colliding_hashes_do_not_merge_texts(spark):
    assert run(spark, ROWS, hash_of=lambda t: F.lit(b"same")) == brute(ROWS, min)


def test_empty(spark):
    assert run(spark, []) == []
