import math
import random

from pyspark.sql import functions as F

from quirelake.llm import license_scan as L
from quirelake.llm.license_scan import license_scan

MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."


def scan(spark, rows, **more):
    frame = spark.createDataFrame([(i, p, t, "x", "y") for i, p, t in rows], "id long, path string, text string, license string, dir string")
    return {(r.id, r.origin): (r.license, r.score, r.from_dir) for r in license_scan(frame, "id", F.col("path"), **more).collect()}


def test_own_and_inherited(spark):
    rows = [
        (1, "LICENSE", MIT),
        (2, "a/b/LICENSE", APACHE),
        (3, "a/b/c/d/x.txt", "some text\nof a file"),
        (4, "a/x.txt", "no notice"),
        (5, "a/b/c/y.txt", f"text of a file that has its own header and more words than that\n{MIT}"),
        (6, "z/w/q.txt", None),
        (7, "a/b/e.txt", "a license that nobody knows"),
    ]
    got = scan(spark, rows)
    assert got[1, "own"][:2] == ("MIT", 1.0) and got[2, "own"][:2] == ("Apache-2.0", 1.0)
    assert got[3, "inherited"] == ("Apache-2.0", 1.0, "a/b") and got[4, "inherited"] == ("MIT", 1.0, "")
    assert got[5, "own"] == ("MIT", 1.0, "a/b/c") and got[6, "inherited"][0] == "MIT"
    assert got[7, "inherited"][0] == "Apache-2.0"


def test_cosine_by_hand(spark):
    import math

    t = [("A", "license alpha"), ("B", "license beta")]
    rows = [(1, "p/a", "License alpha zzz"), (2, "q/b", "license"), (3, "r/c", "beta")]
    got = scan(spark, rows, templates=t, least=0.0)
    i = {w: 1 - math.log(n / 3) for w, n in (("license", 2), ("alpha", 1), ("beta", 1))}
    want = (i["license"] ** 2 + i["alpha"] ** 2) / math.hypot(i["license"], i["alpha"]) / math.sqrt(1 + i["license"] ** 2 + i["alpha"] ** 2)
    assert got[1, "own"][0] == "A" and abs(got[1, "own"][1] - want) < 1e-5
    assert got[2, "own"][0] == "A"


def test_edges(spark):
    assert scan(spark, []) == {}
    rows = [(1, None, None), (2, None, ""), (None, "a/b", MIT), (3, "a/b", "license ..."), (4, "x/y", "word " * 100000 + "\n" + APACHE), (5, "t/LICENSE", APACHE), (6, "t/COPYING", MIT), (7, "t/f", "f")]
    got = scan(spark, rows)
    assert got[1, None] == got[2, None] == (None, None, None)
    assert got[None, "own"][0] == "MIT" and got[3, "inherited"][0] == "MIT" and got[4, "own"][0] == "Apache-2.0"
    assert got[7, "inherited"] == ("Apache-2.0", 1.0, "t")
    assert scan(spark, rows, templates=[])[5, None] == (None, None, None)


def test_headers_texts_and_identifiers(spark):
    by = dict.fromkeys(name for name, _ in L.TEMPLATES)
    for name, text in L.TEMPLATES:
        by[name] = max(by[name] or "", text, key=len)
    wrapped = lambda text, mark: "\n".join(mark + " ".join(text.split()[k : k + 9]) for k in range(0, len(text.split()), 9))
    rows = [(f"{name} header", f"h{i}/f.py", "Copyright (c) 2020 someone\nAll rights reserved.\n\n" + wrapped(text, "# ") + "\n\n" + "code of the file\n" * 40) for i, (name, text) in enumerate(by.items()) if name != L.RESERVED]
    rows += [(f"{name} file", f"f{i}/LICENSE", "Some Title\n\nCopyright 2021\n\n" + wrapped(text, "")) for i, (name, text) in enumerate(by.items()) if len(text) > 300]
    rows += [("MIT id", "s/a.c", "// SPDX-License-Identifier: MIT\n" + "int x;\n" * 30), ("none id", "s2/a.c", "// SPDX-License-Identifier: Nothing-1.0\n"), (f"{L.RESERVED} line", "r/a", "words\nAll rights reserved.\nmore words")]
    frame = spark.createDataFrame(rows, "id string, path string, text string")
    got = {r.id: r for r in license_scan(frame, "id", F.col("path")).collect()}
    for i, r in got.items():
        want = i.rpartition(" ")[0]
        assert r.license == (None if want == "none" else want), (i, r)


def test_telling_words_bound_the_cosine():
    r = random.Random(4)
    units = []
    for _ in range(6):
        u = {w: r.random() for w in r.sample("abcdefghij", 5)}
        size = math.sqrt(sum(x * x for x in u.values()))
        units.append({w: x / size for w, x in u.items()})
    gate = set(L.telling(units, {w: r.random() for w in "abcdefghij"}, 0.75))
    for u in units:
        assert math.sqrt(sum(x * x for w, x in u.items() if w not in gate)) < 0.75


def test_scores_do_not_fall_with_the_table(spark):
    scores = set()
    for n in (50, 3000):
        rows = [(i, f"d{i}/f", "plain words here") for i in range(n)] + [(n, "x/f", "All rights reserved.\nother words"), (n + 1, "y/f", "Under the MIT License")]
        got = scan(spark, rows)
        assert got[n, "own"][0] == L.RESERVED
        scores.add(round(got[n, "own"][1], 1))
    assert scores == {1.0}
