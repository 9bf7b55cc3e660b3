"""Column functions against the parsers' own versions, on many random inputs."""

import random
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirelake.functions import text as T
from quirelake.sources import comic, common, markdown


def test_normalized_agrees(spark):
    r = random.Random(1)
    parts = ["..", ".", "", "a", "b c", "é", "%20", "%zz", "x+y", "d.html"]
    rows = []
    for _ in range(600):
        path = "/".join(r.choice(parts) for _ in range(r.randint(0, 6))) + r.choice(["", "#f", "?q", "%23", "#"])
        rows.append((path, r.choice([None, "", "t", "t/u", "/t//u/"])))
    frame = spark.createDataFrame(rows, "p string, b string")
    for x in frame.withColumn("n", T.normalized(F.col("p"), F.col("b"))).collect():
        assert x.n == common.normalize(x.p, x.b), x


def test_natural_order_agrees(spark):
    r = random.Random(2)
    names = sorted({"".join(r.choice("aB1 02é9_") for _ in range(r.randint(0, 8))) for _ in range(500)})
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [x.n for x in frame.orderBy(T.natural_key(F.col("n")), F.length("n"), "n").collect()]
    assert got == sorted(names, key=comic.natural_key)


def test_bodies_and_slugs_agree(spark):
    r = random.Random(3)
    bits = ["<body>", "<BODY id='q'>", "</body>", "</BODY>", "<p>", "x", ">", "<body"]
    sources = ["".join(r.choice(bits) for _ in range(r.randint(0, 7))) for _ in range(300)]
    frame = spark.createDataFrame([(s,) for s in sources], "s string")
    for x in frame.withColumn("b", T.body(F.col("s"))).collect():
        assert x.b == common.body(x.s)[0], x
    titles = ["".join(r.choice("aB é-_!, 1<b>") for _ in range(r.randint(0, 12))) for _ in range(200)]
    for x in spark.createDataFrame([(t,) for t in titles], "t string").withColumn("s", T.slug(F.col("t"))).collect():
        assert x.s == markdown.slugs()(x.t), x


@given(st.text(max_size=30))
@settings(max_examples=200, deadline=None)
def test_percent_escapes_round_trip(text):
    assert common.unescaped(quote(text)) == text


@given(st.lists(st.sampled_from(["..", ".", "", "a", "b"]), max_size=8))
def test_normalize_is_idempotent_and_stays_inside(parts):
    once = common.normalize("/".join(parts))
    assert common.normalize(once) == once and not once.startswith(("/", "..")) and ".." not in once.split("/")


@given(st.text(alphabet="ab\n-#`:. ", max_size=60))
def test_markdown_never_fails(text):
    found, rest = markdown.front_matter(text)
    assert rest == text or text.startswith("---") or text.lstrip().startswith("---")
    assert isinstance(markdown.to_html(text), str)
