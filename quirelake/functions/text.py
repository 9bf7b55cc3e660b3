"""Text functions of documents: markup, entities, white space, paths, Markdown.

White space is Unicode white space; ids and entities match without regard to case.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rules, apply

SPACE = r"[\x{9}-\x{D}\x{20}\x{85}\p{Z}]"

# The entities that are decoded; others are deleted. The ampersand comes last, so
# what it uncovers is not decoded again.
ENTITIES: Rules = [
    (r"(?i)&nbsp;|&#160;", " "),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"(?i)&quot;", '"'),
    (r"(?i)&apos;|&#39;", "'"),
    (r"(?i)&mdash;", "—"),
    (r"(?i)&ndash;", "–"),
    (r"(?i)&hellip;", "…"),
    (r"(?i)&rsquo;", "’"),
    (r"(?i)&lsquo;", "‘"),
    (r"(?i)&ldquo;", "“"),
    (r"(?i)&rdquo;", "”"),
    (r"(?i)&amp;", "&"),
    (r"&[a-zA-Z]+;|&#[0-9]+;", ""),
]
# How markup becomes a line of text, what is escaped, what a slug keeps.
COLLAPSE: Rules = [(r"<[^>]+>", " "), *ENTITIES, (r"[\x{AD}\x{200B}-\x{200F}\x{FEFF}]", ""), (SPACE + "+", " "), (r"^ +| +$", "")]
ESCAPE: Rules = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
#: Slug of a heading: without tags, of letters, digits, _, - and spaces, which become -.
SLUG: Rules = [(r"<[^>]*>", ""), (r"[^\p{L}\p{N}\s_-]", ""), (r"^\s+|\s+$", ""), (r"\s+", "-")]
# What a book wraps around its markup.
SCAFFOLD: Rules = [(r"(?is)<head\b.*?</head\s*>", ""), (r"(?is)<\?xml[^>]*>|<!DOCTYPE[^>]*>|</?html[^>]*>|</?body[^>]*>", "")]


def collapsed(html: Column) -> Column:
    """Text of markup on one line."""
    return apply(html, COLLAPSE)


def decoded(text: Column) -> Column:
    return apply(text, ENTITIES)


def escaped(text: Column) -> Column:
    return apply(text, ESCAPE)


def slug(title: Column) -> Column:
    return apply(F.lower(title), SLUG)


def body(html: Column) -> Column:
    """Between the first <body ...> and the first </body>; all of it where either is missing or they cross."""
    low = F.lower(html)
    start = F.locate("<body", low)
    end = F.locate("</body>", low)
    close = F.instr(F.substr(html, F.greatest(start, F.lit(1))), ">") + start - 1
    ok = (start > 0) & (end > 0) & (close >= start) & (close < end)
    return F.when(ok, F.substr(html, close + 1, end - close - 1)).otherwise(html)


def body_id(html: Column) -> Column:
    found = F.regexp_extract(F.regexp_extract(html, r"(?i)<body[^>]*>", 0), r"id\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.when(F.locate("</body>", F.lower(html)) > 0, F.nullif(found, F.lit("")))


def prefixed(html: Column, chapter: Column) -> Column:
    """ids, anchor names and in-page links carry the chapter, so chapters can be joined on one page."""
    mark = F.concat(F.lit("ch"), chapter.cast("string"), F.lit("--"))
    out = html
    # Where ids and links stand
    for pattern in (r"([\s\"']id=\")([^\"]+\")", r"([\s\"']id=')([^']+')", r"(href=\"#)([^\"]+\")", r"(href='#)([^']+')"):
        out = F.regexp_replace(out, F.lit("(?i)" + pattern), F.concat(F.lit("$1"), mark, F.lit("$2")))
    named = F.regexp_replace(out, F.lit(r"(?i)(<a\s[^>]*\bname\s*=\s*[\"'])([^\"']+[\"'])"), F.concat(F.lit("$1"), mark, F.lit("$2")))
    return F.regexp_replace(named, r"(?i)<a(?![^>]*id=)(\s[^>]*\bname\s*=\s*[\"'])([^\"']+)([\"'][^>]*>)", '<a id="$2"$1$2$3')


def percent_decoded(text: Column) -> Column:
    """Percent-decoded; as it is where an escape is broken. A plus stays a plus."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def percent_encoded(path: Column) -> Column:
    """Percent-encoded, slashes kept."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def normalized(path: Column, base: Column) -> Column:
    """Root-relative spelling of a reference in a document of folder base: decoded first, then cut at # and ?."""
    value = F.regexp_extract(percent_decoded(path), r"(?s)^([^#?]*)", 1)
    full = F.when(value.startswith("/"), value).otherwise(F.concat_ws("/", F.coalesce(base, F.lit("")), value))
    empty = F.array().cast("array<string>")
    parts = F.aggregate(F.split(full, "/", -1), empty, lambda out, x: F.when(x.isin("", "."), out).when(x == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(x))))
    return F.array_join(parts, "/")


def fragment(reference: Column) -> Column:
    """What follows the first #, decoded; null where nothing does."""
    return percent_decoded(F.nullif(F.regexp_extract(reference, r"(?s)^[^#]*#(.*)$", 1), F.lit("")))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def first_text(html: Column, *tags: str) -> Column:
    """Collapsed text of the first of the tags that has any."""
    return F.coalesce(*[F.nullif(collapsed(F.regexp_extract(html, rf"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in tags])


def size_note(shown: Column, whole: Column) -> Column:
    """How much of a text is shown."""
    return F.format_string("first %.0f MB of %.0f MB", shown / F.lit(1048576.0), whole / F.lit(1048576.0))


def tolerant_int(text: Column) -> Column:
    """true and false as 1 and 0, numbers cut to integers, else null."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes"), 1).when(low.isin("false", "no"), 0).otherwise(low.try_cast("double").try_cast("bigint")).cast("long")


# Media types by extension.
MEDIA = {
    "html": "text/html", "htm": "text/html", "xhtml": "application/xhtml+xml", "css": "text/css", "js": "text/javascript", "json": "application/json", "xml": "application/xml",
    "txt": "text/plain", "md": "text/markdown", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp",
    "bmp": "image/bmp", "ttf": "font/ttf", "otf": "font/otf", "woff": "font/woff", "woff2": "font/woff2",
}


def media_type(path: Column) -> Column:
    ext = extension(path)
    found = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    return F.coalesce(F.try_element_at(found, ext), F.lit("application/octet-stream"))


def searchable(format_name: Column) -> Column:
    """Formats of page images have no text to search."""
    return ~format_name.isin("djvu", "cbz")


# Extensions and the format each is read as.
FORMATS = {"epub": "epub", "mobi": "mobi", "azw": "azw", "azw3": "azw3", "fb2": "fb2", "djvu": "djvu", "djv": "djvu", "cbz": "cbz", "cbt": "cbz", "chm": "chm", "md": "markdown", "markdown": "markdown", "mdx": "markdown"}


def book_format(path: Column) -> Column:
    found = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(found, extension(path))


def display_title(series: Column, number: Column, title: Column) -> Column:
    return F.coalesce(F.when(number.isNotNull(), F.concat(series, F.lit(" #"), number)).otherwise(series), title)


def window_title(title: Column, author: Column) -> Column:
    return F.concat_ws(" — ", F.nullif(title, F.lit("")), F.nullif(author, F.lit("")))


def card(title: Column, stem: Column, author: Column, format_name: Column, html: Column) -> list[Column]:
    """Title, subtitle and opening text of a thumbnail."""
    return [
        F.coalesce(F.nullif(title, F.lit("")), stem).alias("title"),
        F.coalesce(F.nullif(author, F.lit("")), F.upper(format_name)).alias("subtitle"),
        F.left(collapsed(F.left(html, F.lit(200000))), F.lit(600)).alias("opening"),
    ]


def natural_key(name: Column) -> Column:
    """Sorts as people read: runs of digits as numbers of any size, letters without regard to case.

    A run has its number of digits in front, so a longer one is greater; ties break on the name.
    """
    bare = F.regexp_replace(F.lower(name), r"(^|[^0-9])0+(?=[0-9])", "$1")
    runs = F.regexp_extract_all(bare, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(x).cast("string"), 10, "0"), x)).otherwise(x)), "")


# Markdown


def front_matter(text: Column) -> Column:
    """(title, author, body) of a text whose first line is --- and that closes it with --- or ...; without, the text as body."""
    shape = r"(?s)^---[ \t]*\r?\n(.*?)(?:^|(?<=\n))(?:---|\.\.\.)[ \t]*(?:\r?\n|$)"
    head = F.regexp_extract(text, shape, 1)
    has = text.rlike(shape)

    def value(key: str) -> Column:
        raw = F.trim(F.regexp_extract(head, rf"(?im)^{key}:[ \t]*(.*?)[ \t\r]*$", 1))
        return F.when(has, F.nullif(F.regexp_replace(raw, "^([\"'])(.*)\\1$", "$2"), F.lit("")))

    return F.struct(value("title").alias("title"), value("author").alias("author"), F.when(has, F.regexp_replace(text, shape, "")).otherwise(text).alias("body"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _fences(text: Column) -> Column:
    """Each line with whether it opens or closes a fence and whether it lies in one."""
    parts = F.split(F.concat(F.lit("\n"), text), r"(?md)(?=^[^\S\n]*(?:```|~~~))", -1)  # every second one lies in a fence
    last = F.size(parts) - 1

    def marked(part: Column, k: Column) -> Column:
        own = F.when(k == 0, F.substring(part, 2, 1 << 30)).otherwise(part)
        nothing = (k == 0) & (last > 0) & (own == "")
        own = F.when(k < last, F.regexp_replace(own, r"\n\z", "")).otherwise(own)
        rows = F.transform(lines(own), lambda x, j: F.struct(x.alias("line"), ((j == 0) & (k > 0)).alias("fence"), ((k % 2 == 1) | ((j == 0) & (k > 0))).alias("inside")))
        return F.when(nothing, F.slice(rows, 1, 0)).otherwise(rows)

    return F.flatten(F.transform(parts, marked))


def without_mdx(text: Column) -> Column:
    """Without import and export lines outside fences."""
    kept = F.filter(_fences(text), lambda x: x["inside"] | ~x["line"].rlike(r"^(import|export)\b"))
    return F.array_join(F.transform(kept, lambda x: x["line"]), "\n")


def fence_classes(text: Column) -> Column:
    """Of the fences that open in a text: mermaid, math, or code."""
    opening = F.filter(F.transform(_fences(text), lambda x: F.when(x["fence"], F.lower(F.regexp_extract(x["line"], r"^\s*(?:```|~~~)\s*(\w*)", 1)))), lambda x: x.isNotNull())
    odd = F.filter(opening, lambda x, i: i % 2 == 0)
    return F.transform(odd, lambda x: F.when(x == "mermaid", "mermaid").when(x.isin("math", "latex", "tex"), "math").otherwise("code"))


# Environments that hold a formula, and spans of formulas.
ENVIRONMENTS = [
    "equation", "align", "alignat", "gather", "multline", "eqnarray", "displaymath", "math", "array", "darray", "dcases", "cases", "rcases",
    "matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "smallmatrix", "subarray", "aligned", "alignedat", "gathered", "split", "CD",
]
MATH = "".join(rf"\\begin\{{{name}\*?\}}[\s\S]*?\\end\{{{name}\*?\}}|" for name in ENVIRONMENTS)
MATH += r"\$\$[^$]+\$\$|\\\([^\n]+?\\\)|\\\[[^$]+?\\\]|\$[^\s$](?:[^$\n]*[^\s$])?\$"


def math_spans(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MATH), F.lit(0))


def code_lines(code: Column) -> Column:
    """(lines, whether they fold, whether they resize); one line feed at the end does not count."""
    n = F.size(lines(F.regexp_replace(code, "\n$", ""))).cast("long")
    return F.struct(n.alias("n_lines"), (n > 12).alias("folds"), (n > 3).alias("resizes"))


# Guessed headings; labels are lower-cased.
# Words that name a level, running heads, titles of contents.

LEVELS = [
    (r"^(part|teil|часть|книга|том)\s+([ivxlc]+|[0-9]+)\b", 1),
    (r"^(chapter|kapitel|глава|раздел)\s+[0-9ivxlc]+[.:)]?\s*\S", 2),
    (r"^(appendix|preface|foreword|prologue|epilogue|introduction|conclusion|afterword|glossary|bibliography|references|notes|index|приложение|предисловие|заключение|примечания)(\s|$)", 2),
]
RUNNING = [
    r"^(references|notes|index|contents|bibliography|оглавление|содержание|примечания)\s*[0-9]*$",
    r"^(epilogue|prologue|appendix|glossary)\s+[0-9]+$",
]
CONTENTS = ("contents", "table of contents", "document outline", "оглавление", "содержание")


def heading_like(label: Column, limit: int) -> Column:
    """Long enough, not a sentence, not an address, not a running head."""
    n = F.length(label)
    return (n >= 3) & (n <= limit) & ~label.rlike(r"[.,;]$") & ~label.contains("http") & ~label.contains("@") & ~label.contains("://") & ~label.rlike(RUNNING[0]) & ~label.rlike(RUNNING[1])


def guessed_level(label: Column) -> Column:
    found = F.when(~heading_like(label, 80), F.lit(None).cast("int"))
    for pattern, level in LEVELS:
        found = found.when(label.rlike(pattern), level)
    return found


# Books and their pages


def annotations(text: Column) -> Column:
    """(background, zoom, metadata) of a page's annotations; of equal keys the last one counts."""
    block = F.regexp_extract(text, r"(?m)\(\s*metadata\b([\s\S]*?)\)\s*$", 1)
    pair = r'\(\s*([\w-]+)\s+"((?:[^"\\]|\\.)*)"\s*\)'
    keys, values = (F.regexp_extract_all(block, F.lit(pair), F.lit(k)) for k in (1, 2))
    rows = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = F.filter(rows, lambda x, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), x["key"]))
    return F.struct(
        F.concat(F.lit("#"), F.nullif(F.regexp_extract(text, r"\(\s*background\s+#?([0-9A-Fa-f]{6})\s*\)", 1), F.lit(""))).alias("background"),
        F.nullif(F.regexp_extract(text, r"\(\s*zoom\s+([a-z0-9]+)\s*\)", 1), F.lit("")).alias("zoom"),
        F.map_from_entries(last).alias("metadata"),
    )


def cut_at_heading(html: Column, limit: int, window: int = 4000) -> Column:
    """The first `limit` characters of a longer text, back to the last heading of the last `window` of them."""
    shown = F.left(html, F.lit(limit))
    tail = F.right(shown, F.lit(window))
    back = F.locate("h<", F.reverse(F.lower(tail)))
    return F.when(F.length(html) <= limit, html).when(back > 0, F.left(shown, F.length(shown) - back - 1)).otherwise(shown)


def anchor_place(html: Column, offset: Column, window: int = 512) -> Column:
    """Where to plant an anchor for a byte offset (from 0): there on a <, else behind the > before it, if that is near."""
    data = F.to_binary(html, F.lit("utf-8"))
    at = F.least(F.greatest(offset, F.lit(0)), F.octet_length(html)).cast("int")
    start = F.greatest(at - window, F.lit(0))
    before = F.hex(F.substr(data, start + 1, at - start))
    near = F.when(before.rlike("^(..)*3E"), at - (F.length(F.regexp_extract(before, "^(?:..)*3E((?:..)*?)$", 1)) / 2).cast("int"))
    return F.when(F.hex(F.substr(data, at + 1, F.lit(1))) == "3C", at).otherwise(F.coalesce(near, at))


def embedded_pictures(html: Column) -> Column:
    """The three spellings of an embedded picture as mobi/<number from 0>: base-32 and decimal from 1, and resource files."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"

    def numbered(text: Column, pattern: str, number, before: str = "", after: str = "") -> Column:
        parts = F.split(text, f"(?i)(?={pattern})|(?<={pattern})", -1)
        return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"(?i)^{pattern}$"), F.concat(F.lit(before + "mobi/"), number(x).cast("string"), F.lit(after))).otherwise(x)), "")

    def base32(x: Column) -> Column:
        code = F.upper(F.regexp_extract(x, "(?i)embed:([0-9A-Z]{4})", 1))
        return F.aggregate(F.split(code, ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 32 + F.instr(F.lit(digits), c) - 1)) - 1

    out = numbered(F.regexp_replace(html, r"(?i)(kindle:embed:[0-9A-V]{4})\?[^\"\s>]*", "$1"), "kindle:embed:[0-9A-V]{4}", base32)
    out = numbered(out, 'recindex=\\"[0-9]{1,6}\\"', lambda x: F.regexp_extract(x, "([0-9]+)", 1).cast("int") - 1, 'src="', '"')
    return numbered(out, r"resource[0-9]{5}\.[A-Za-z0-9]{1,5}(?![A-Za-z0-9])", lambda x: F.regexp_extract(x, "([0-9]{5})", 1).cast("int"))


def page_label(title: Column, name: Column, ident: Column, index: Column) -> Column:
    """A page's own title unless it is a file's name; else its number from 1."""
    is_file = F.lower(title).rlike(r"\.(djvu|djv|tiff?|jpe?g|png|gif|bmp|pdf|pbm|pgm|ppm)$")
    own = (title != "") & ~is_file & ~title.eqNullSafe(name) & ~title.eqNullSafe(ident)
    return F.when(own, title).otherwise((index + 1).cast("string"))


def page_frame(index: Column, width: Column, height: Column) -> Column:
    """The box of a page image, with its shape where that is known."""
    shape = F.when((width > 0) & (height > 0), F.concat(F.lit(' style="aspect-ratio: '), width.cast("string"), F.lit(" / "), height.cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<div class="page-frame" data-page="'), index.cast("string"), F.lit('" data-label="'), (index + 1).cast("string"), F.lit('"'), shape, F.lit("></div>"))


def contents_label(language: Column) -> Column:
    return F.when(F.lower(language).startswith("zh"), "目录").otherwise("Contents")


def octal(text: Column) -> Column:
    """A number of octal digits, as tar headers hold; null where there are none."""
    return F.conv(F.nullif(F.regexp_extract(text, r"^[\s\x{0}]*([0-7]+)", 1), F.lit("")), 8, 10).cast("long")


def contents_target(section: Column, fragment: Column, path: Column) -> Column:
    """In-page link of an entry: its fragment, or its section with the fragment; null for an unknown section."""
    tail = F.nullif(fragment, F.lit(""))
    return F.when(path.isNull(), F.concat(F.lit("#"), tail)).otherwise(F.concat(F.lit("#ch"), section.cast("string"), F.coalesce(F.concat(F.lit("--"), tail), F.lit(""))))


def error_summary(error: Column) -> Column:
    """A parse error in words."""
    return (
        F.when(error.isNull(), None)
        .when(error.contains("encrypted"), "This book is encrypted")
        .when(error.contains("unsupported"), "Unsupported book type")
        .when(error.rlike("ends early|bad |damaged"), "Damaged book data")
        .when(error.rlike("malformed|no package document|no spine"), "This book could not be read")
        .otherwise("Cannot open this book")
    )


def is_noise(path: Column) -> Column:
    """Bookkeeping of operating systems in an archive."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return path.startswith("__MACOSX/") | path.startswith(".") | name.startswith("._") | name.startswith("Thumbs.db") | (name == ".DS_Store")


# Extensions of pictures.
PICTURES = ["jpg", "jpeg", "jpe", "png", "gif", "webp", "bmp", "tif", "tiff", "avif", "heic"]


def is_picture(path: Column) -> Column:
    return extension(path).isin(*PICTURES)


def follows_settings(path: Column) -> Column:
    """Books that are read again when settings change."""
    return book_format(path).isin("markdown", "fb2")


def decode_bytes(data: Column, declared: Column, fallbacks: tuple[str, ...] = ("utf-8", "windows-1251")) -> Column:
    """Text of binary data by the first charset that decodes: declared, then the fallbacks, then Latin-1."""
    @F.pandas_udf("string")
    def run(blobs: pd.Series, names: pd.Series) -> pd.Series:
        from quirelake.sources.common import decode

        return pd.Series([None if b is None else decode(bytes(b), n, *fallbacks) for b, n in zip(blobs, names, strict=True)])

    return run(data, declared)
