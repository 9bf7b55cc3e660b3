import html
import random
import re

from quirelake.llm import html_extract as H

DATA = "/root/testdata/sf0.01"
DEFAULT = {"": H.WORD}


def test_pages_give_their_article(spark):
    rows = {r.page_id: r for r in H.op1_html_extraction(spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_parts_that_are_no_article():
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <div class="cookie-notice">we use cookies</div><div id="sidebar"><ul><li>side <b>bar</b></li></ul></div>
    <div class=content><h1>The&nbsp;title</h1><p>One  two &amp; three<br>four <a href="#">link</a> text of words and words.</p>
    <form><p>your mail</p></form><script>if (a < b) document.write("<p>no</p>")</script><div class="advert"><div>buy</div> now</div>
    <ul><li>first point of it</li><li>second point of it</li></ul><p hidden>secret</p></div>
    <section class="comments"><article><p>Reader says a lot of things here</p></article></section><footer>&copy; me</footer></body></html>"""
    assert H.extract(page, DEFAULT) == "The title\nOne two & three four link text of words and words.\nfirst point of it\nsecond point of it"


def test_region_is_the_best_subsequence():
    weight = {"": 1.0, "div": -5.0}
    assert H.extract("<div>a b</div><div></div><p>c d e f g h</p><p>i</p><div></div><div>j</div>", weight) == "c d e f g h\ni"


def test_edges(spark):
    for source in (None, "", "<p></p>", "<<<", "<script>x", "<!-- open", "<a b='c"):
        assert H.extract(source, DEFAULT) in ("", "<<<")
    assert H.extract("a < b and c > d", DEFAULT) == "a < b and c > d"
    assert H.extract("<div class='ad'>x<article><p>kept words</p></article>", DEFAULT) == "kept words"
    long = "<p>" + "word " * 200000 + "</p>"
    rows = [(1, "u", None, "k"), (1, "u", None, "k"), (None, None, "<p>a b</p>", None), (2, "u", long, "k")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = H.extract_text(frame, ["page_id", "url", "text"])
    assert found.columns == ["page_id", "url", "text"]
    got = found.collect()
    assert [r.text for r in got] == ["", "", "a b", ("word " * 200000).strip()]
    assert H.extract_text(frame.limit(0), ["page_id"]).collect() == []


def test_weights():
    seen = H.Counter({("", True): 900, ("", False): 50, ("p", True): 20, ("div", False): 30})
    w = H.weights(seen)
    assert w[""] > 0 and w["div"] < -2 and w["p"] == -0.02
    assert H.weights(H.Counter()) == {"": H.WORD}


def test_hidden_is_an_attribute_or_a_style():
    body = "<p>some words of the article stay here</p>"
    for attrs in ('class="overflow-hidden"', 'style="overflow:hidden"', 'aria-hidden="false"', 'data-x="/hidden-valley"', 'title="the hidden text"', 'data-note="display: none"'):
        assert H.extract(f"<div {attrs}>{body}</div>", DEFAULT) == "some words of the article stay here", attrs
    for attrs in ("hidden", 'hidden=""', "class=x hidden", "aria-hidden=true", "style='color: red; display : none'"):
        assert H.extract(f"{body}<div {attrs}><p>gone</p></div>", DEFAULT) == "some words of the article stay here", attrs


def test_a_form_around_the_page_stays():
    inner = "<div><p>some words of the article stay here</p></div>"
    for form in ("<form>", '<form id="aspnetForm" class="form" action="/x">'):
        assert H.extract(f"<body>{form}{inner}</form><p>foot</p></body>", DEFAULT).startswith("some words of the article stay here")
    assert H.extract(f"{inner}<form><p>your mail</p></form>", DEFAULT) == "some words of the article stay here"


def test_names_that_tell_a_state_or_mislead():
    body = "<p>some words of the article stay here</p><p>and more of them</p><p>and the last ones</p>"
    text = "some words of the article stay here\nand more of them\nand the last ones"
    for attrs in ('class="content with-sidebar"', 'class="overflow-hidden"', 'aria-hidden="false"', 'id=page class="has-menu"', 'class="search page"', 'class="overlay"'):
        assert H.extract(f"<body><div {attrs}>{body}</div></body>", DEFAULT) == text, attrs
    assert H.extract(f"<body><form>{body}</form></body>", DEFAULT) == text
    assert H.extract(f"<article>{body}<p class='ad-free'>one more</p></article>", DEFAULT) == text + "\none more"
    assert H.extract(f"<article>{body}<div class='ad'>buy this</div><p>one more</p></article>", DEFAULT) == text + "\none more"
    assert H.extract(f"<main>{body}<div id='comments'><article>a reader says things</article></div></main>", DEFAULT) == text


def test_names_are_learnt():
    """A name that says nothing is told by the labelled pages; without them it stays."""
    side = "<div class='x9'><p>side words that every page repeats next to it</p></div>"
    labelled = [f"<body>{side}<div class=w><article><p>text number {i} of the article</p><p>goes on</p></article></div></body>" for i in range(200)]
    seen = H.Counter()
    for page in labelled:
        seen.update(H.counts(page))
    page = f"<body>{side}<div class=w><p>some words of an unmarked article</p><p>more</p></div>{side}</body>"
    assert H.extract(page, H.weights(seen)) == "some words of an unmarked article\nmore"
    assert "side words" in H.extract(page, DEFAULT)


def test_scan_against_all_regions():
    r = random.Random(3)
    for _ in range(200):
        tags = ["<div>", "</div>", "<p>", "<hr>", "<h2>"]
        page = "".join(r.choice(tags) if r.random() < 0.6 else " ".join("w" for _ in range(r.randint(1, 4))) + f"{i} " for i in range(r.randint(1, 25)))
        weight = {"": 1.0, "div": -r.choice([1.5, 3.25]), "p": -0.75, "hr": -6.0}
        tokens = H.parse(page).tokens
        value = [n * 1.0 if tag is None else weight.get(tag, H.TAG) for tag, n, _, _ in tokens]
        best = max([0.0, *(sum(value[a:b]) for a in range(len(value)) for b in range(a + 1, len(value) + 1))])
        got = H.extract(page, weight)
        regions = {" ".join(H.extract("".join(()), weight)), ""} if not best else set()
        for a in range(len(value)):
            for b in range(a + 1, len(value) + 1):
                if best and abs(sum(value[a:b]) - best) < 1e-9:
                    page_of = H.parse(page)
                    lines = (" ".join("".join(t for _, t in block).split()) for block in page_of.blocks[tokens[a][2] : tokens[b - 1][2] + 1])
                    regions.add("\n".join(x for x in lines if x))
        assert got in regions
