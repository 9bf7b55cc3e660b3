import random

from quirelake.llm.line_dedup import line_dedup


def brute(rows, run, long=200):
    docs = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    full = {x: [i for i, line in enumerate(x[2].split("\n")) if line.strip(" \t\r")] for x in docs}
    first, gone = {}, {x: set() for x in docs}
    for x in docs:
        lines = x[2].split("\n")
        for p in range(len(full[x]) - run + 1):
            key = tuple(lines[i] for i in full[x][p : p + run])
            if key in first:
                gone[x] |= set(full[x][p : p + run])
            first.setdefault(key, (x, p))
        for i in full[x]:
            if len(lines[i]) >= long:
                if ("line", lines[i]) in first:
                    gone[x].add(i)
                first.setdefault(("line", lines[i]), (x, i))
    out = []
    for d, t in rows:
        x = (d is not None, d or 0, t or "")
        kept = None if t is None else "\n".join(line for i, line in enumerate(x[2].split("\n")) if i not in gone[x])
        out.append((d, kept, len(full[x]), len(gone[x])))
    return sorted(out, key=repr)


def check(spark, rows, run=2, long=200):
    frame = spark.createDataFrame([(d, t, 1, "g") for d, t in rows], "doc_id long, text string, k int, gone string")
    got = line_dedup(frame, run=run, long=long)
    assert got.columns == ["doc_id", "text", "k", "gone", "_n_lines", "_n_removed"]
    assert sorted(((r.doc_id, r.text, r._n_lines, r._n_removed) for r in got.collect()), key=repr) == brute(rows, run, long)


def test_against_brute_force(spark):
    for seed, run in ((1, 2), (2, 3), (3, 1), (4, 5)):
        r = random.Random(seed)
        pool = ["a", "b", "c", "d", "", " ", "a ", "long line"]
        rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(60)]
        check(spark, rows, run)


def test_edges(spark):
    many = "\n".join(f"line {i % 700}" for i in range(20000))
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "a\nb"), (4, "a\nb"), (4, "a\nb"), (5, "x\na\nb\ny"), (6, "q\nq\nq\nq"), (7, many)]
    check(spark, rows)
    check(spark, [])
    check(spark, [(1, None)])


def test_long_lines_go_on_their_own(spark):
    for seed, run in ((5, 2), (6, 3)):
        r = random.Random(seed)
        pool = ["a", "b", "a long line", "another é line", "", "c", "the long é"]
        check(spark, [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)], run, 10)


def test_columns_with_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a\nb", 5, 6, 7), (2, "a\nb", 5, 6, 7)], "doc_id long, text string, _n_lines int, marks int, places int")
    got = line_dedup(frame)
    assert got.columns == ["doc_id", "text", "marks", "places", "_n_lines", "_n_removed"] and [r._n_removed for r in got.orderBy("doc_id").collect()] == [0, 2]
