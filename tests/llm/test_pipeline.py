from pyspark.sql import functions as F

import corpus_pipeline as P

from . import test_decontaminate, test_line_dedup, test_near_dedup

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = P.language(spark, docs, SF).cache()
    assert known.columns == columns
    kept = {r.doc_id: r.text for r in known.collect()}
    assert len(kept) > 0.95 * len(rows) and all(rows[d] == t for d, t in kept.items())

    found = P.lines(spark, known, SF).cache()
    assert found.columns == columns
    want = {d: t for d, t, n, gone in test_line_dedup.brute(list(kept.items()), 2) if not gone or gone < n}
    got = {r.doc_id: r.text for r in found.collect()}
    assert got == want and all(r.n_chars == len(r.text) for r in found.collect())

    near = P.near_copies(spark, found, SF).cache()
    assert near.columns == columns
    want = {d: got[d] for d, root in test_near_dedup.brute(list(got.items())) if d == root}
    got = {r.doc_id: r.text for r in near.collect()}
    assert got == want

    clean = P.benchmark(spark, near, SF).cache()
    assert clean.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d for d, _, hit, _ in test_decontaminate.brute(list(got.items()), items) if not hit}
    assert {r.doc_id for r in clean.collect()} == want

    pieces = P.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == want
    assert [name for name, _ in P.STAGES] == ["language ID", "line dedup", "near dedup", "decontamination", "packing"]


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0), (3, "the cat sat", "en", "s", 11), (3, "the cat sat", "en", "s", 11), (None, "der hund\nund die katze", "de", "s", 1)], schema)
    for frame in (docs, docs.limit(0)):
        for _, stage in P.STAGES:
            frame = stage(spark, frame, SF)
        rows = frame.collect()
        assert len(rows) in (0, 2)


def test_columns_with_clashing_names(spark):
    """Extra columns of names that operators use pass through every stage but the last."""
    names = "score lang_pred _row _n_lines _n_removed _starts _ends _found _id _null _n k marks gone h u text_".split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.col("doc_id").cast("string"), F.lit(f" {i}")))
    docs = docs.cache()
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        assert docs.columns[-len(names) :] == names and rows and all(r[name] == f"{r.doc_id} {i}" for r in rows for i, name in enumerate(names))
    assert P.STAGES[-1][1](spark, docs, SF).count() >= len(rows)
