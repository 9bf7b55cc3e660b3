import random

from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.operators import find, guess, links, outline, positions, runs


def test_headings(spark):
    html = '<h1 id="x">A</h1><h2></h2><H3 class=c>B <i>c</i></h3><h2>open</h3><h2>' + "y" * 601 + "</h2><h2>D</h2>"
    many = "".join(f"<h1>{i}</h1>" for i in range(900))
    frame = spark.createDataFrame([(1, 0, html), (1, 1, "<h2>E</h2>"), (2, 0, many), (3, 0, None)], "book int, s int, html string")
    rows = outline.headings(frame, ["book"], "s", "html").orderBy("book", "heading_idx").collect()
    assert [(r.section_idx, r.heading_idx, r.level, r.title, r.anchor) for r in rows if r.book == 1] == [(0, 0, 1, "A", "x"), (0, 1, 3, "B c", "ch0--h1"), (0, 2, 2, "D", "ch0--h2"), (1, 3, 2, "E", "ch1--h3")]
    assert sum(r.book == 2 for r in rows) == 800
    alone = outline.headings(frame.where("s = 0"), ["book"], None, "html")
    assert alone.where("book = 2").count() == 800


def test_parents_and_folds_against_stacks(spark):
    r = random.Random(2)
    rows = [(b, i, r.randint(1, 6)) for b in range(5) for i in range(40)]
    frame = spark.createDataFrame(rows, "b int, i int, level int")
    got = {(x.b, x.i): (x.parent_idx, x.fold_end) for x in outline.folds(outline.parents(frame, ["b"], "i", "level"), ["b"], "i", "level").collect()}
    for b, i, level in rows:
        parent = max((j for c, j, k in rows if c == b and j < i and k < level), default=None)
        end = min((j for c, j, k in rows if c == b and j > i and k <= level), default=None)
        assert got[b, i] == (parent, end)


def test_spliced(spark):
    nodes = [("b", 0, "a", None), ("b", 1, "", 0), ("b", 2, "c", 1), ("b", 3, "", 1), ("b", 4, "e", 3), ("b", 5, "f", 9), ("b", 6, "", None), ("b", 7, "g", 6)]
    frame = spark.createDataFrame(nodes, "book string, idx int, title string, parent_idx int")
    got = {r.idx: r.parent_idx for r in outline.spliced(frame, ["book"]).collect()}
    assert got == {0: None, 2: 0, 4: 0, 5: None, 7: None}


def test_find(spark):
    cases = [("aaaa", "aa", 2), ("Straße STRASSE", "strasse", 1), ("İx ix", "İX", 0), ("İx ix", "ix", 1), ("abc", "  ", 0), ("Aa", " a ", 2)]
    frame = spark.createDataFrame(cases, "t string, q string, want int")
    for r in frame.withColumn("n", find.occurrences(F.col("t"), F.col("q"))).collect():
        assert r.n == r.want, r
    nodes = spark.createDataFrame([("<p>ab</p>c<script>d</script><b>e</b>",)], "h string").select(find.text_nodes(F.col("h"))).first()[0]
    assert nodes == ["ab", "c", "e"]
    s = spark.range(1).select(*find.summary(F.lit(2500), F.lit(True), F.lit(1001))).first()
    assert tuple(s) == (True, 1000, 1, True)
    assert tuple(spark.range(1).select(*find.summary(F.lit(3), F.lit(True), F.lit(-1))).first()) == (True, 3, 2, False)
    assert tuple(spark.range(1).select(*find.summary(F.lit(3), F.lit(False), F.lit(0))).first()) == (False, 0, -1, False)


EVENTS = "path string, ts long, seq long, kind string, title string, author string, size long, anchor string, section_offset double, fraction double, scroll_y double"


def test_ledger(spark):
    rows = [
        ("a", 10, 1, "store", None, None, None, "x", 0.1, 0.2, 3.0),
        ("a", 20, 2, "open", "T", "", 5, None, None, None, None),
        ("a", 20, 3, "open", "", "A", None, None, None, None, None),
        ("a", 30, 4, "store", None, None, None, "y", 0.5, 0.6, 7.0),
        ("b", 5, 5, "open", None, None, 9, None, None, None, None),
    ]
    got = {r.path: r for r in positions.ledger(spark.createDataFrame(rows, EVENTS)).collect()}
    a, b = got["a"], got["b"]
    assert (a.title, a.author, a.size, a.opens, a.first_read, a.last_read, a.updated, a.anchor, a.scroll_y) == ("T", "A", None, 2, 0, 20, 30, "y", 7.0)
    assert (b.opens, b.first_read, b.last_read, b.anchor, b.size) == (1, 5, 5, None, 9)
    frame = positions.ledger(spark.createDataFrame(rows, EVENTS))
    assert positions.lookup(frame, F.lit("b"), F.lit(8)).count() == 0
    assert positions.lookup(frame, F.lit("b"), F.lit(None).cast("long")).count() == 1
    assert [r.path for r in positions.pruned(frame, [F.desc("updated")], 1).collect()] == ["a"]


def test_asof(spark):
    marks = spark.createDataFrame([(1, 0.0, "a"), (1, 10.0, "b"), (1, 10.0, "c"), (2, 5.0, "d")], "g int, m double, v string")
    points = spark.createDataFrame([(1, 1, -3.0), (1, 2, -2.0), (1, 3, 8.0), (1, 4, 7.9), (2, 5, 99.0), (3, 6, 1.0)], "g int, id int, p double")
    got = {r.id: r.v for r in positions.asof(points, marks, ["g"], "p", "m", ["v"], tolerance=2.0).collect()}
    assert got == {1: None, 2: "a", 3: "c", 4: "a", 5: "d", 6: None}


def test_runs_and_budget(spark):
    frame = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "g int, i int, v string")
    assert [r.run for r in runs.consecutive(frame, ["g"], ["i"], "v").orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]
    sizes = spark.createDataFrame([(1, 0, 4), (1, 1, 5), (1, 2, 9), (1, 3, 1)], "g int, i int, n int")
    assert [r.i for r in runs.within_budget(sizes, ["g"], ["i"], F.col("n"), 10).collect()] == [0, 1]


def test_links(spark):
    html = """<a href="a.html#f">x</a><img src="http://h.example/i.png"><img src='q.png'><video poster="p&amp;q.png"><a href="mailto:x@y">"""
    got = links.links(spark.createDataFrame([(1, html)], "id int, html string"), ["id"], "html")
    rows = got.withColumn("c", links.link_class(F.col("raw"), F.col("attr"))).orderBy("link_idx").collect()
    assert [(r.attr, r.raw, r.c) for r in rows] == [("href", "a.html#f", "internal"), ("src", "http://h.example/i.png", "blocked"), ("poster", "p&q.png", "internal"), ("href", "mailto:x@y", "external")]
    sections = spark.createDataFrame([("b", 0, "t/a.html"), ("b", 1, "t/c.html"), ("b", 2, "t/c.html")], "book string, section_idx int, path string")
    refs = spark.createDataFrame([("b", "../t/c.html#%C3%A9", "t"), ("b", "#z", "t"), ("b", "x.html", "t"), ("b", "a.html", "t")], "book string, raw string, base string")
    target = {r.raw: r.target for r in links.resolved(refs, sections, ["book"]).collect()}
    assert target == {"../t/c.html#%C3%A9": "#ch1--é", "#z": "#z", "x.html": None, "a.html": "#ch0"}
    inside = spark.createDataFrame([("a/b.png",), ("../x.png",), ("../root2/x",)], "p string").select(links.inside(F.col("p"), F.lit("root"))).collect()
    assert [r[0] for r in inside] == [True, False, False]


def test_promoted_contents(spark):
    """Against a plain loop over the three tiers."""
    r = random.Random(7)
    rows = []
    for b in range(30):
        for i in range(24):
            label = r.choice(["chapter 1 x", "part ii", "epilogue", "bold words", "text here", "contents", "a sentence.", "title " + str(r.randint(0, 5))])
            s = i // 6
            rows.append((b, i, label, s, s + 1, s * 6, r.choice([2, 6]), r.random() < 0.3))
    schema = "book int, idx int, label string, section int, depth int, section_first int, section_size int, bold boolean"
    frame = spark.createDataFrame(rows, schema)
    level = {x.label: x.v for x in frame.select("label", T.guessed_level(F.col("label")).alias("v")).distinct().collect()}
    like = {x.label: x.v for x in frame.select("label", T.heading_like(F.col("label"), 140).alias("v")).distinct().collect()}
    want = []
    for b in range(30):
        mine = [x for x in rows if x[0] == b]
        seen, out = set(), []
        contents = {x[3] for x in mine if x[1] == x[5] and x[2] == "contents"}
        for x in mine:
            if x[1] == x[5] and x[6] >= 3 and like[x[2]] and x[2] not in seen:
                seen.add(x[2])
                out.append((b, x[1], 1, min(max(x[4], 1), 3)))
        spare = [x for x in mine if not (x[3] in contents and len(out) >= 3)]
        named = 0
        for x in spare:
            if level[x[2]] is not None and x[2] not in seen:
                seen.add(x[2])
                out.append((b, x[1], 2, level[x[2]]))
                named += 1
        for x in spare:
            if named < 3 and x[7] and x[2] not in seen:
                seen.add(x[2])
                out.append((b, x[1], 3, 2))
        want += out
    got = [(x.book, x.idx, x.tier, x.level) for x in guess.promoted(frame, ["book"]).collect()]
    assert sorted(got) == sorted(want)
