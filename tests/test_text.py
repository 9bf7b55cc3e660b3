import pytest
from pyspark.sql import functions as F

from quirelake.functions import text as T


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    frame = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return frame.select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "base", "want"),
    [
        ("../a%20b.html#x", "OEBPS/text", "OEBPS/a b.html"),
        ("/root.png?q", "OEBPS", "root.png"),
        ("a+b", None, "a+b"),
        ("%zz", "x", "x/%zz"),
        ("../../../x", "a/b", "x"),
        ("./a//b/.", "", "a/b"),
        ("a%23b.html", "d", "d/a"),
        ("", "d/e", "d/e"),
        ("%E4%B8%AD.html", None, "中.html"),
    ],
)
def test_normalized(spark, path, base, want):
    assert one(spark, T.normalized, path, base) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>a&nbsp;b</p>\n c", "a b c"),
        ("&amp;lt;b&amp;gt;", "b"),
        ("x&unknown;y&#123;z", "xyz"),
        (" a­b​c﻿  d e", "abc d e"),
        ("&MDASH;&Ndash;&hellip;&rsquo;&lsquo;&ldquo;&rdquo;", "—–…’‘“”"),
        ("&quot;&apos;&#39;&lt;", "\"''<"),
        ("", ""),
    ],
)
def test_collapsed(spark, html, want):
    assert one(spark, T.collapsed, html) == want


@pytest.mark.parametrize(
    ("html", "content", "body_id"),
    [
        ("<html><BODY id='b1' class=x>in</Body>out", "in", "b1"),
        ("no body", "no body", None),
        ("<body>open", "<body>open", None),
        ("</body><body>x", "</body><body>x", None),
        ('<body data-x="1">a<body>b</body>c</body>', "a<body>b", None),
    ],
)
def test_body(spark, html, content, body_id):
    assert one(spark, T.body, html) == content
    assert one(spark, T.body_id, html) == body_id


def test_prefixed(spark):
    html = """<p id="a"><p id='b'><a name="n">x</a><a id="k" name="m"></a><a href="#a">y</a><a href='#b'>z</a><a href="#"></a><a href="f#a"></a>"""
    got = one(spark, lambda c: T.prefixed(c, F.lit(3)), html)
    assert got == """<p id="ch3--a"><p id='ch3--b'><a id="ch3--n" name="ch3--n">x</a><a id="ch3--k" name="ch3--m"></a><a href="#ch3--a">y</a><a href='#ch3--b'>z</a><a href="#"></a><a href="f#a"></a>"""


def test_natural_order(spark):
    names = ["page10", "page9", "Page2", "a01", "a1b", "a0001", "x" + "9" * 30, "x" + "9" * 29, "b"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in frame.orderBy(T.natural_key(F.col("n")), F.length("n"), "n").collect()]
    assert got == ["a01", "a0001", "a1b", "b", "Page2", "page9", "page10", "x" + "9" * 29, "x" + "9" * 30]


def test_slug_and_titles(spark):
    assert one(spark, T.slug, "Héllo, <b>Wörld</b>! 2_x-y ") == "héllo-wörld-2_x-y"
    assert one(spark, lambda h: T.first_text(h, "title", "h1"), "<title> </title><h1>A <i>b</i></h1>") == "A b"
    assert one(spark, T.window_title, "", "author") == "author"
    assert one(spark, T.display_title, "S", "2", "t") == "S #2" and one(spark, T.display_title, None, "2", "t") == "t"
    assert one(spark, T.percent_encoded, "a b/c+d%") == "a%20b/c%2Bd%25"


def test_front_matter(spark):
    closed = one(spark, T.front_matter, '---\ntitle: "A b"\nauthor: C\n---\n# x\n')
    assert (closed.title, closed.author, closed.body) == ("A b", "C", "# x\n")
    dots = one(spark, T.front_matter, "---\ntitle: T\n...\nbody")
    assert (dots.title, dots.author, dots.body) == ("T", None, "body")
    for text in ("---\ntitle: T\nno end", "x\n---\n", ""):
        got = one(spark, T.front_matter, text)
        assert (got.title, got.author, got.body) == (None, None, text)


def test_markdown(spark):
    text = "import x\n```js\nimport y\n```\nexport z\nimportant\n~~~ mermaid\n~~~"
    assert one(spark, T.without_mdx, text) == "```js\nimport y\n```\nimportant\n~~~ mermaid\n~~~"
    assert one(spark, T.fence_classes, text) == ["code", "mermaid"]
    assert one(spark, T.fence_classes, "```tex\nx\n```") == ["math"]
    assert one(spark, T.math_spans, "$5 and $10, $x+1$ $$y\nz$$ \\(q\\)") == ["$x+1$", "$$y\nz$$", "\\(q\\)"]
    assert one(spark, T.code_lines, "a\nb\nc\n").asDict() == {"n_lines": 3, "folds": False, "resizes": False}


@pytest.mark.parametrize(
    ("label", "level"),
    [("part iv", 1), ("глава 3. начало", 2), ("chapter 2: x", 2), ("chapter 2", None), ("epilogue", 2), ("epilogue 113", None), ("notes", None), ("index of it", 2), ("part one.", None), ("see http part 1", None), ("ab", None)],
)
def test_guessed_level(spark, label, level):
    assert one(spark, T.guessed_level, label) == level


def test_coercion_and_types(spark):
    assert [one(spark, T.tolerant_int, x) for x in ("True", " no", "3.9", "x", None)] == [1, 0, 3, None, None]
    assert one(spark, T.media_type, "a/B.JPG") == "image/jpeg" and one(spark, T.media_type, "x") == "application/octet-stream"
    assert [one(spark, T.book_format, x) for x in ("a.EPUB", "b.cbt", "c.djv", "d.txt", "e")] == ["epub", "cbz", "djvu", None, None]


def test_pages_of_books(spark):
    assert one(spark, lambda h: T.cut_at_heading(h, 12, 8), "abcdef<h1>xyz") == "abcdef"
    assert one(spark, lambda h: T.cut_at_heading(h, 12, 2), "abcdef<h1>xyz") == "abcdef<h1>xy"
    assert one(spark, lambda h: T.cut_at_heading(h, 99), "abc") == "abc"
    html = 'é<p class="x">ab<i>'
    for offset, want in ((0, 0), (2, 2), (8, 8), (17, 16), (99, 21), (19, 18)):
        data = html.encode()
        at = min(max(offset, 0), len(data))
        place = at
        if at < len(data) and data[at : at + 1] != b"<":
            near = data[max(0, at - 512) : at].rfind(b">")
            place = max(0, at - 512) + near + 1 if near >= 0 else at
        assert one(spark, lambda h, o=offset: T.anchor_place(h, F.lit(o)), html) == place, offset
    got = one(spark, T.embedded_pictures, '<img src="kindle:embed:0010?mime=image/jpg"><img recindex="00013"><i src="resource00042.jpg">')
    assert got == '<img src="mobi/31"><img src="mobi/12"><i src="mobi/42">'
    frame = spark.createDataFrame([("a.djvu", "n", "i", 0), ("Cover", "n", "i", 1), ("n", "n", "i", 2), ("", None, None, 3)], "t string, n string, i string, k int")
    assert [r[0] for r in frame.select(T.page_label(F.col("t"), F.col("n"), F.col("i"), F.col("k"))).collect()] == ["1", "Cover", "3", "4"]


def test_small_functions(spark):
    assert [one(spark, T.octal, x) for x in ("0000644\0", "  17 ", "x", "")] == [0o644, 0o17, None, None]
    assert one(spark, T.contents_label, "zh-Hans") == "目录" and one(spark, T.contents_label, "en") == "Contents"
    frame = spark.createDataFrame([(1, "f", "p"), (1, None, "p"), (None, "f", "p"), (None, "f", None), (None, "", None)], "s int, f string, p string")
    assert [r[0] for r in frame.select(T.contents_target(F.col("s"), F.col("f"), F.col("p"))).collect()] == ["#ch1--f", "#ch1", None, "#f", None]
    assert one(spark, T.error_summary, "MOBI container is encrypted") == "This book is encrypted" and one(spark, T.error_summary, None) is None
    raw = spark.createDataFrame([("привет".encode("windows-1251"), None), ("é".encode("latin-1"), "utf-8"), ("中".encode("gb18030"), "gb18030"), (None, None)], "b binary, c string")
    assert [r[0] for r in raw.select(T.decode_bytes(F.col("b"), F.col("c"))).collect()] == ["привет", "й", "中", None]
