"""HTML extraction by the maximum-scoring subsequence of a page's words and tags.

Words score positive and tags negative, with weights from the pages that mark one article: log odds
of a token inside and outside it. Class, id and role names and tags of parts have such weights too,
which start from what common names mean. A part whose name and tag say that it is no article text
is left out, and one linear scan finds the contiguous region with the highest score in the rest.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import beside, mapped, small_batches, table

# Names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template textarea iframe svg select head title".split())
CHROME = set("nav footer aside form menu dialog button fieldset".split())
ARTICLE = ("article", "main")
KNOWN = VOID | INLINE | CHROME | set("address blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header html li ol p pre section summary table tbody td tfoot th thead tr ul video audio canvas".split())
#: Elements that the start of another one ends, up to the list or table that holds them.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDERS = set("ul ol dl menu table".split())
#: What words of names say before any page is read.
ASIDE = set(
    "ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager "
    "sidebar aside footer foot masthead toolbar notice notices cookie cookies consent gdpr popup modal overlay alert subscribe subscription newsletter signup login search "
    "share sharing social widget form contentinfo complementary skip skiplink".split()
)
TALK = set("comment comments commentlist reply replies respond disqus related recommended".split())
HEADS = set("header head".split())
CONTENT = set("article content body entry main page post prose story text".split())
#: With one of these in it, a name tells a state and no part: has-menu, ad-free, overflow-hidden.
STATES = set("with without has have no not free hide hidden is on off open closed fixed enabled disabled active".split())
#: Weights of words and tags where no page is labelled; of parts that names or tags set aside, and that hold talk.
WORD, TAG, APART, TALKING = 0.7, -0.3, -4.0, -12.0
#: Words under a name that weigh as much as what it means; numbers into which names are hashed.
PRIOR, NAMES = 300, 1 << 16

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)", re.S
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"hidden|display\s*:\s*none", re.I)
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)


@dataclass
class Page:
    """parts: (parent, tag, words of each name, hidden, within a marked article); tokens: (tag, or None for text; words; block; part); blocks: (part, text)."""

    parts: list[tuple[int, str, list[list[str]], bool, bool]] = field(default_factory=lambda: [(-1, "", [], False, False)])
    tokens: list[tuple[str | None, int, int, int]] = field(default_factory=list)
    blocks: list[list[tuple[int, str]]] = field(default_factory=lambda: [[]])
    marked: int = 0


def names(attrs: str) -> list[list[str]]:
    """The words of each class, id and role."""
    found = [_SPLIT.split(x) for m in _NAMED.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split()]
    return [y for x in found if (y := [w.lower() for w in x if w])]


def hidden(attrs: str) -> bool:
    """Whether the attribute hidden, aria-hidden="true" or the style display:none is among attrs."""
    if not _HIDDEN.search(attrs):
        return False
    for found in _ATTRIBUTE.finditer(attrs):
        name, value = found[1].lower(), found[2] or found[3] or found[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _NONE.search(value):
            return True
    return False


def parse(source: str | None) -> Page:
    """Tokens of what a page shows, and the parts of it that they stand in."""
    page, source, at = Page(), source or "", 0
    stack = [("", 0)]  # open elements with the part each one is or stands in
    n = len(source)

    def text(part: str) -> None:
        part = html.unescape(part)
        here = stack[-1][1]
        page.blocks[-1].append((here, part))
        page.tokens.append((None, len(part.split()), len(page.blocks) - 1, here))

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            text(source[at:])
            break
        if lt > at:
            text(source[at:lt])
        found = _TOKEN.match(source, lt)
        if not found:
            text("<")
            at = lt + 1
            continue
        at = found.end()
        tag, end, attrs = (found["tag"] or found["tag2"] or "").lower(), found["end"] or found["end2"], found["attrs"] or found["attrs2"] or ""
        if not tag:
            continue
        if tag in RAW and not end:
            if not attrs.endswith("/"):
                close = re.compile(r"</head\b[^>]*>|(?=<body\b)" if tag == "head" else rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else n if tag in ("script", "style") else at
            continue
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            if tag not in INLINE:  # a block ends a paragraph, an item the item before it
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
            for k in range(len(stack) - 1, 0, -1) if tag in ENDED else ():
                if stack[k][0] in HOLDERS:
                    break
                if stack[k][0] in ENDED[tag]:
                    del stack[k:]
                    break
            here = stack[-1][1]
            called, unseen = names(attrs) if tag not in ("body", "html") else [], hidden(attrs) and tag not in ("body", "html")
            inside = page.parts[here][4]
            if called or unseen or tag in CHROME or tag == "header" or tag in ARTICLE:
                if tag in ARTICLE and not inside:
                    page.marked += 1
                page.parts.append((here, tag, called, unseen, inside or tag in ARTICLE))
                here = len(page.parts) - 1
            stack.append((tag, here))
        if tag == "br":
            page.blocks[-1].append((stack[-1][1], " "))
        elif tag not in INLINE:
            page.blocks.append([])
        page.tokens.append((tag, 0, len(page.blocks) - 1, stack[-1][1]))
    return page


def bucket(word: str) -> str:
    """The feature of a word of a name; there is a fixed number of them."""
    return f"name {zlib.crc32(word.encode()) % NAMES}"


def says(words: list[str], inside: bool, weight: dict[str, float]) -> float:
    """What a name says of a part: below 0 that it is no article text."""
    if STATES.intersection(words):
        return 0.0
    found = []
    for w in words:
        prior = TALKING if w in TALK else APART if w in ASIDE or w in HEADS and not inside and not CONTENT.intersection(words) else -APART if w in CONTENT else 0.0
        n = weight.get(f"n {bucket(w)}", 0.0)
        found.append((PRIOR * prior + n * weight.get(bucket(w), 0.0)) / (PRIOR + n))
    return min(found) if min(found) < -0.5 else max(found)


def scores(page: Page, weight: dict[str, float]) -> list[float]:
    """Of each part what it and those around it say; text below -word is left out. An article starts anew, but not within talk."""
    out, talk = [], []
    for parent, tag, called, unseen, inside in page.parts:
        if parent < 0:
            out.append(0.0), talk.append(False)
            continue
        around = page.parts[parent][4]
        own = sum((says(x, around, weight) for x in called), 0.0)
        if tag in CHROME or tag == "header" and not around:
            n = weight.get(f"n {tag}", 0.0)
            own += (PRIOR * APART + n * weight.get(f"part {tag}", 0.0)) / (PRIOR + n)
        talk.append(talk[parent] or any(TALK.intersection(x) and not STATES.intersection(x) for x in called))
        total = out[parent]
        if tag in ARTICLE and not around and not talk[-1]:
            total, own = max(total, 0.0), max(own, 0.0)
        out.append(-99.0 if unseen or total < -50 else min(1.0, total + own))
    return out


def kept(page: Page, weight: dict[str, float]) -> list[bool]:
    """Whether the text of each part counts. Where next to nothing would, names mislead: the part with most words is taken after all."""
    total, word = scores(page, weight), weight.get("", WORD)
    words = [0] * len(total)
    for tag, n, _, part in page.tokens:
        if tag is None:
            words[part] += n
    while True:
        good = [x + word > 0 for x in total]
        every, left = sum(n for n, x in zip(words, total, strict=True) if x > -50), sum(n for n, x in zip(words, good, strict=True) if x)
        if left >= max(5, every // 50) or page.marked and any(good[k] and words[k] for k, x in enumerate(page.parts) if x[4]):
            return good
        below = [0] * len(total)  # words of a part and the parts in it
        for k in range(len(total) - 1, 0, -1):
            below[k] += words[k]
            below[page.parts[k][0]] += below[k]
        bad = [k for k in range(1, len(total)) if not good[k] and total[k] > -50 and good[page.parts[k][0]] and below[k]]
        if not bad:
            return good
        first = max(bad, key=lambda k: below[k])
        raised = {first: -total[first]}
        for k in range(first, len(total)):
            lift = raised.get(k, raised.get(page.parts[k][0]))
            if lift is not None and total[k] > -50:
                raised[k] = lift
                total[k] += lift


def counts(source: str | None) -> Counter:
    """(token or feature, inside) of a page that marks one article; words count as the empty token."""
    page, found = parse(source), Counter()
    if page.marked != 1:
        return found
    good, marks = kept(page, {}), []
    for parent, tag, called, _, _ in page.parts:
        own = {f"part {tag}"} if tag in CHROME or tag == "header" else set()
        marks.append((marks[parent] if parent >= 0 else frozenset()) | own | {bucket(w) for x in called if not STATES.intersection(x) for w in x})
    for tag, words, _, part in page.tokens:
        inside = page.parts[part][4]
        if tag is None:
            found["all", inside] += words
            for x in marks[part]:
                found[x, inside] += words
            if good[part]:
                found["", inside] += words
        elif good[part] and tag not in ARTICLE:
            found[tag if tag in KNOWN else "other", inside] += 1
    return found


def weights(seen: Counter) -> dict[str, float]:
    """Log odds of tokens and features inside and outside the marked articles; words at least 0.1, tags at most -0.02."""
    apart = {x for x, _ in seen if x == "all" or x[:5] in ("name ", "part ")}
    inside, outside = (sum(n for (x, where), n in seen.items() if where == side and x not in apart) for side in (True, False))
    found, odds = {}, math.log((seen["all", True] + 1) / (seen["all", False] + 1))
    for name in {x for x, _ in seen} if inside else ():
        if name in apart:
            found[name] = max(-8.0, min(4.0, math.log((seen[name, True] + 0.5) / (seen[name, False] + 0.5)) - odds))
            found[f"n {name.removeprefix('part ')}"] = seen[name, True] + seen[name, False]
            continue
        token = math.log((seen[name, True] + 0.5) / (inside + 1)) - math.log((seen[name, False] + 0.5) / (outside + 1))
        found[name] = min(3.0, max(0.1, token)) if not name else max(-6.0, min(-0.02, token))
    return {"": found.get("", WORD)} | found


def extract(source: str | None, weight: dict[str, float]) -> str:
    """The text of the best region: its blocks, white space folded, joined by line feeds."""
    page = parse(source)
    good, word = kept(page, weight), weight.get("", WORD)
    best, total, start, region, skipped = 0.0, 0.0, 0, (0, 0), -1
    for k, (tag, words, _, part) in enumerate(page.tokens):
        if not good[part]:
            if skipped == part:  # a part that is left out counts as one tag
                continue
            skipped = part
        if total <= 0:
            total, start = 0.0, k
        total += (words * word if good[part] else 0.0) if tag is None else weight.get(tag, TAG)
        if total > best:
            best, region = total, (start, k + 1)
    if region[0] == region[1]:
        return ""
    first, last = page.tokens[region[0]][2], page.tokens[region[1] - 1][2]
    lines = (" ".join("".join(text for part, text in block if good[part]).split()) for block in page.blocks[first : last + 1])
    return "\n".join(x for x in lines if x)


def learn(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights from every page that marks exactly one article or main element. The driver gets a row for each tag and hashed name."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for x in batch.column(0):
                total.update(counts(x.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([k for _, k in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], ["name", "inside", "n"])

    rows = pages.select(html_col).mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n")).collect()
    return weights(Counter({(r["name"], r["inside"]): r["n"] for r in rows}))


def extract_text(pages: DataFrame, keep: list[str], html_col: str = "html", weight: dict[str, float] | None = None) -> DataFrame:
    """keep's columns of every row and `text`, the main text of the whole html.

    Null and empty html, and pages without words, give an empty text; a page of any length is read
    whole. A page whose best regions tie gives the first of them. Elements left open end where
    their parent does; an article starts anew whatever is open. Repeated rows stay; an empty table
    gives no row. A kept column named `text` gives way to the result.
    """
    weight = learn(pages, html_col) if weight is None else weight
    sent = pages.sparkSession.sparkContext.broadcast(weight)

    def run(sources: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([extract(x.as_py(), sent.value) for x in sources], pa.string())], ["text"])

    return beside(pages, keep, mapped(pages.sparkSession, run, "text string", F.col(f"`{html_col}`")), {"text": "text"})


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.withColumn("n_chars", F.length("text").cast("long"))
