"""Readers over books that are made of the supplied tables: a file for each conversation, customer or part, parsed as any other.

The SQL says what was put into the files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links as L
from ..operators import positions as P
from ..sources import bind
from ..sources.reader import parse_bundles, parse_files, read_zones, rows_of
from ..streaming.ledgers import merged
from .catalog import query, table
from .positions import LEDGER, events


def files(rows: DataFrame, make: Callable[[dict], list[tuple[str, bytes]]]) -> DataFrame:
    """(path, content) that make gives for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [x for row in batch.to_pylist() for x in make(row)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in made], pa.string()), pa.array([c for _, c in made], pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def talks(spark, sf_dir) -> DataFrame:
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns)


def number(column: str = "path"):
    """The number in a book's name."""
    return F.regexp_extract(column, r"([0-9]+)\.[a-z0-9]+$", 1).cast("long")


def epubs(spark, sf_dir, thumbnails: bool = False) -> DataFrame:
    make = lambda r: [(f"b{r['conv_id']}.epub", bind.epub(r["conv_id"], r["turns"], r["conv_id"] % 2 == 1, r["conv_id"] % 3 > 0))]
    return parse_files(files(talks(spark, sf_dir), make), thumbnails)


_TALK = "SELECT conv_id, arg_min(role, turn) AS role, arg_min(text, turn) AS text, min(turn) AS turn, count(*) AS n FROM conversations GROUP BY conv_id"
_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_QUOTED = "replace(replace(" + _XML + ", '\"', '&quot;'), '''', '&#x27;')"
_NTH = "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1"


@query("epub_metadata", f"SELECT conv_id, 'Talk ' || conv_id AS title, role || ' & others' AS author, 'en' AS language, 'id' || conv_id AS identifier, 'p' AS cover_path, 'OEBPS' AS toc_base, n AS n_sections FROM ({_TALK})")
def epub_metadata(spark, sf_dir):
    return epubs(spark, sf_dir).select(number().alias("conv_id"), "title", "author", "language", "identifier", "cover_path", "toc_base", F.size("sections").cast("long").alias("n_sections"))


@query("epub_sections", f"""SELECT conv_id, ({_NTH})::INT AS section_idx, 'OEBPS/text/t ' || turn || '.xhtml' AS source_path, 'OEBPS/text' AS base_path, 'b' || turn AS body_id,
md5('<h1>' || role || '</h1><p>' || {_XML.format('text')} || '</p>') AS html_md5 FROM conversations""")
def epub_sections(spark, sf_dir):
    rows = rows_of(epubs(spark, sf_dir), "sections")
    return rows.select(number("book").alias("conv_id"), "section_idx", "source_path", "base_path", "body_id", F.md5("html").alias("html_md5"))


@query("epub_thumbnail", f"SELECT conv_id, 1::BIGINT AS n_sections, 0::BIGINT AS n_resources, md5('<h1>' || role || '</h1><p>' || {_XML.format('text')} || '</p>') AS html_md5 FROM ({_TALK})")
def epub_thumbnail(spark, sf_dir):
    return epubs(spark, sf_dir, True).select(number().alias("conv_id"), F.size("sections").cast("long").alias("n_sections"), F.size("resources").cast("long").alias("n_resources"), F.md5(F.col("sections")[0]["html"]).alias("html_md5"))


@query("epub_bundles", f"SELECT conv_id, 'Talk ' || conv_id AS title, n AS n_sections, 2 * n AS n_entries FROM ({_TALK})")
def epub_bundles(spark, sf_dir):
    """The same books unpacked, a row for each file."""

    def make(r: dict) -> list[tuple[str, bytes]]:
        with zipfile.ZipFile(io.BytesIO(bind.epub(r["conv_id"], r["turns"], r["conv_id"] % 2 == 1, True))) as z:
            return [(f"/x/b{r['conv_id']}.epub/{quote(n)}", z.read(n)) for n in z.namelist()]

    found = parse_bundles(files(talks(spark, sf_dir), make))
    return found.select(number().alias("conv_id"), "title", F.size("sections").cast("long").alias("n_sections"), F.size("toc").cast("long").alias("n_entries"))


def _contents(odd: int) -> str:
    at = "'OEBPS/text/t ' || turn || '.xhtml'"
    return f"""WITH t AS (SELECT conv_id, turn, role, 2 * ({_NTH}) AS k FROM conversations WHERE conv_id % 2 = {odd})
SELECT conv_id, k::INT AS entry_idx, NULL::INT AS parent_idx, 0 AS depth, role || ' ' || turn AS title, {at} AS section_path, NULL AS fragment FROM t
UNION ALL SELECT conv_id, (k + 1)::INT, k::INT, 1, 'end', {at}, 'b' || turn FROM t"""


def contents(spark, sf_dir, odd: int) -> DataFrame:
    return rows_of(epubs(spark, sf_dir), "toc").withColumn("conv_id", number("book")).where(F.col("conv_id") % 2 == odd).drop("book")


@query("epub_nav", _contents(0))
def epub_nav(spark, sf_dir):
    return contents(spark, sf_dir, 0)


@query("epub_ncx", _contents(1))
def epub_ncx(spark, sf_dir):
    return contents(spark, sf_dir, 1)


@query("book_resources", f"SELECT conv_id, 'OEBPS/p.png' AS path, 'image/png' AS mime, 24::BIGINT AS n_bytes FROM ({_TALK})")
def book_resources(spark, sf_dir):
    rows = rows_of(epubs(spark, sf_dir), "resources").where("path = 'OEBPS/p.png'")
    return rows.select(number("book").alias("conv_id"), "path", "mime", F.octet_length("content").cast("long").alias("n_bytes"))


CHARSETS = ("utf-8", "windows-1252", "unknown-8", "iso-8859-1", None)


def fb2s(spark, sf_dir) -> DataFrame:
    make = lambda r: [(f"b{r['conv_id']}.fb2", bind.fb2(r["conv_id"], r["turns"], CHARSETS[r["conv_id"] % 5]))]
    return parse_files(files(talks(spark, sf_dir), make))


@query("fb2_description", f"SELECT conv_id, 'Talk of' AS title, role || ' Z, N' AS author, 'en' AS language, CASE conv_id % 5 WHEN 4 THEN 'Книга ' ELSE 'Talk ' END || conv_id AS identifier, 'c.jpg' AS cover_path, conv_id % 5 = 4 AS toc_is_fallback FROM ({_TALK})")
def fb2_description(spark, sf_dir):
    return fb2s(spark, sf_dir).select(number().alias("conv_id"), "title", "author", "language", "identifier", "cover_path", "toc_is_fallback")


@query("fb2_markup", f"""SELECT conv_id, md5(string_agg('<div class="fb2-section"><h1>' || role || '</h1><p>' || {_QUOTED.format('text')} || '</p></div>', '' ORDER BY turn)) AS html_md5 FROM conversations WHERE conv_id % 5 <> 4 GROUP BY conv_id""")
def fb2_markup(spark, sf_dir):
    rows = rows_of(fb2s(spark, sf_dir), "sections").withColumn("conv_id", number("book")).where("conv_id % 5 <> 4")
    return rows.select("conv_id", F.md5("html").alias("html_md5"))


@query("fb2_binaries", f"SELECT conv_id, 'c.jpg' AS path, 'image/jpeg' AS mime, md5(text) AS content_md5 FROM ({_TALK})")
def fb2_binaries(spark, sf_dir):
    return rows_of(fb2s(spark, sf_dir), "resources").select(number("book").alias("conv_id"), "path", "mime", F.md5("content").alias("content_md5"))


#: Formats of a page by order, and their extension.
KINDS = ("png", "jpg", "gif", "bmp")


def comic_of(row: dict) -> list[tuple[str, bytes]]:
    key = row["o_custkey"]
    pages = {f"p{x['o_orderkey']}.{KINDS[x['o_orderkey'] % 4]}": bind.picture(KINDS[x["o_orderkey"] % 4], 100 + x["o_orderkey"] % 50, 200 + x["o_orderkey"] % 70) for x in reversed(row["orders"])}
    last = next(iter(pages))
    info = f"<ComicInfo><Series>S</Series><Number>{key}</Number><Writer> W{key} </Writer><Pages><Page Image='0' Bookmark='start'/><Page image='{last.upper()}' bookmark='end'/><Page Image='x' Bookmark='no'/></Pages></ComicInfo>"
    held = {"__MACOSX/p0.png": b"", "._p0.png": b"", "readme.txt": b"x", **pages, "ComicInfo.xml": info.encode()}
    return [(f"c{key}.cbz", bind.zipped(held) if key % 3 == 0 else bind.tarred(held, key % 3 == 1))]


def by_customer(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey"))).alias("orders"))


def comics(spark, sf_dir) -> DataFrame:
    return parse_files(files(by_customer(spark, sf_dir), comic_of))


@query("comic_pages", """SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page_idx, 'p' || o_orderkey AS label, list_extract(['png', 'jpg', 'gif', 'bmp'], (o_orderkey % 4)::INT + 1) AS kind,
(100 + o_orderkey % 50)::INT AS width, (200 + o_orderkey % 70)::INT AS height FROM orders""")
def comic_pages(spark, sf_dir):
    return rows_of(comics(spark, sf_dir), "pages").select(number("book").alias("o_custkey"), "page_idx", "label", T.extension(F.col("path")).alias("kind"), "width", "height")


@query("comic_info", "SELECT o_custkey, 'S #' || o_custkey AS title, 'W' || o_custkey AS author, 0 AS first_mark, (count(*) - 1)::INT AS last_mark, ['start', 'end'] AS marks FROM orders GROUP BY o_custkey")
def comic_info(spark, sf_dir):
    marks = F.col("bookmarks")
    return comics(spark, sf_dir).select(number().alias("o_custkey"), "title", "author", marks[0]["page_idx"].alias("first_mark"), marks[1]["page_idx"].alias("last_mark"), marks["title"].alias("marks"))


def djvu_of(row: dict) -> list[tuple[str, bytes]]:
    key = row["o_custkey"]
    return [(f"d{key}.djvu", bind.djvu([(1000 + x["o_orderkey"] % 97, 900 + x["o_orderkey"] % 89, 10 + x["o_orderkey"] % 600) for x in row["orders"]], f'T\\"{key}', f"A{key}"))]


def djvus(spark, sf_dir) -> DataFrame:
    return parse_files(files(by_customer(spark, sf_dir), djvu_of))


_DPI = "CASE WHEN 10 + o_orderkey % 600 < 25 OR (10 + o_orderkey % 600) % 256 = 255 THEN 300 ELSE 10 + o_orderkey % 600 END"


@query("djvu_pages", f"SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page_idx, (1000 + o_orderkey % 97)::INT AS width, (900 + o_orderkey % 89)::INT AS height, ({_DPI})::INT AS dpi FROM orders")
def djvu_pages(spark, sf_dir):
    return rows_of(djvus(spark, sf_dir), "pages").select(number("book").alias("o_custkey"), "page_idx", "width", "height", "dpi")


@query("djvu_metadata", "SELECT o_custkey, 'T\"' || o_custkey AS title, 'A' || o_custkey AS author, (CASE WHEN count(*) > 1 THEN count(*) ELSE 0 END)::BIGINT AS n_entries FROM orders GROUP BY o_custkey")
def djvu_metadata(spark, sf_dir):
    return djvus(spark, sf_dir).select(number().alias("o_custkey"), "title", "author", F.size("toc").cast("long").alias("n_entries"))


@query("djvu_page_files", f"SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page_idx, (1000 + o_orderkey % 97)::INT AS width, ({_DPI})::INT AS dpi FROM orders")
def djvu_page_files(spark, sf_dir):
    """Each page as a file of its own, read again."""
    rows = rows_of(djvus(spark, sf_dir), "resources")
    again = parse_files(rows.select(F.concat("book", F.lit("/"), F.col("path"), F.lit(".djvu")).alias("path"), "content"), resources=False)
    page = F.col("pages")[0]
    return again.select(F.regexp_extract("path", "^d([0-9]+)", 1).cast("long").alias("o_custkey"), number().cast("int").alias("page_idx"), page["width"].alias("width"), page["dpi"].alias("dpi"))


_ZONE = "SELECT o_custkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page_idx, o_orderkey::VARCHAR AS k FROM orders"


@query("djvu_zones", f"""WITH o AS ({_ZONE})
SELECT o_custkey, page_idx, 0 AS zone_idx, NULL::INT AS parent_idx, 'page' AS kind, 0 AS xmin, 0 AS ymin, 1000 AS xmax, 800 AS ymax, 'order ' || k AS text FROM o
UNION ALL SELECT o_custkey, page_idx, 1, 0, 'line', 10, 750, 510, 780, 'order ' || k FROM o UNION ALL SELECT o_custkey, page_idx, 2, 1, 'word', 10, 750, 60, 780, 'order' FROM o
UNION ALL SELECT o_custkey, page_idx, 3, 1, 'word', 65, 750, (65 + 10 * length(k))::INT, 780, k FROM o""")
def djvu_zones(spark, sf_dir):
    """Hidden text of pages, with the boxes of its line and words."""

    def make(row: dict) -> list[tuple[str, bytes]]:
        pages = [(1000, 800, 300)] * len(row["orders"])
        return [(f"d{row['o_custkey']}.djvu", bind.djvu(pages, "T", "A", [["order", str(x["o_orderkey"])] for x in row["orders"]]))]

    found = read_zones(files(by_customer(spark, sf_dir), make))
    return found.select(number().alias("o_custkey"), "page_idx", "zone_idx", "parent_idx", "kind", "xmin", "ymin", "xmax", "ymax", "text")


@query("djvu_annotations", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '#00fF0' || (p_partkey % 10) END AS background, CASE WHEN p_partkey % 3 > 0 THEN 'page' END AS zoom, p_name AS title, 'a\\"' || p_size AS author, 2 AS n_keys FROM part""")
def djvu_annotations(spark, sf_dir):
    key = F.col("p_partkey")
    text = F.concat(
        F.when(key % 2 == 0, F.concat(F.lit("( background #00fF0"), (key % 10).cast("string"), F.lit(" )\n"))).otherwise(""),
        F.when(key % 3 > 0, "(zoom page) ").otherwise(""),
        F.lit('(metadata (Title "first") (Title "'), F.col("p_name"), F.lit('") (author "a\\"'), F.col("p_size").cast("string"), F.lit('"))\n'),
    )
    found = T.annotations(text)
    return table(spark, sf_dir, "part").select("p_partkey", found["background"].alias("background"), found["zoom"].alias("zoom"), found["metadata"]["Title"].alias("title"), found["metadata"]["author"].alias("author"), F.size(found["metadata"]).alias("n_keys"))


@query("fb2_entities", "SELECT doc_id, 'A B €' || doc_id || ' é &nosuch; <' AS title FROM documents")
def fb2_entities(spark, sf_dir):
    """Entities of HTML in XML, which knows five: the others become characters, unknown ones stay."""

    def make(r: dict) -> list[tuple[str, bytes]]:
        return [(f"e{r['doc_id']}.fb2", f"<FictionBook><description><title-info><book-title>A&nbsp;B &euro;{r['doc_id']} &eacute; &nosuch; &amp;lt;</book-title></title-info></description><body/></FictionBook>".encode())]

    books = parse_files(files(table(spark, sf_dir, "documents").select("doc_id"), make), resources=False)
    return books.select(number().alias("doc_id"), "title")


def mobis(spark, sf_dir) -> DataFrame:
    def make(r: dict) -> list[tuple[str, bytes]]:
        body = "".join(bind.page(x["role"], x["text"]) for x in r["turns"])
        return [(f"m{r['conv_id']}.mobi", bind.mobi(f"Talk {r['conv_id']}", [r["turns"][0]["role"], "B"], body.encode(), (1, 2, 17480)[r["conv_id"] % 3]))]

    return parse_files(files(talks(spark, sf_dir), make))


@query("mobi_books", f"""SELECT t.conv_id, 'Talk ' || t.conv_id AS title, t.role || ', B' AS author, 'en' AS language, c.html_md5, 'mobi/0' AS picture FROM ({_TALK}) AS t
JOIN (SELECT conv_id, md5(string_agg('<h1>' || role || '</h1><p>' || {_XML.format('text')} || '</p>', '' ORDER BY turn)) AS html_md5 FROM conversations GROUP BY conv_id) AS c USING (conv_id)""")
def mobi_books(spark, sf_dir):
    return mobis(spark, sf_dir).select(number().alias("conv_id"), "title", "author", "language", F.md5(F.col("sections")[0]["html"]).alias("html_md5"), F.col("resources")[0]["path"].alias("picture"))


@query("mobi_contents", f"""SELECT conv_id, ({_NTH})::INT AS entry_idx, CASE WHEN {_NTH} > 0 THEN 0 END::INT AS parent_idx, role || ' ' || turn AS title,
md5(string_agg('<a id="fp' || (10 * turn) || '"></a>', '') OVER (PARTITION BY conv_id ORDER BY turn)) AS anchors_md5 FROM conversations""")
def mobi_contents(spark, sf_dir):
    """An index with an entry for each turn, below the first; each offset gets its anchor."""

    def make(r: dict) -> list[tuple[str, bytes]]:
        text = b"".join(b"<p>word%02d" % (x["turn"] % 100) for x in r["turns"]).ljust(10 * max(x["turn"] for x in r["turns"]) + 20, b".")
        entries = [(f"{x['role']}  {x['turn']} ", 10 * x["turn"], 0 if k else None) for k, x in enumerate(r["turns"])]
        return [(f"m{r['conv_id']}.mobi", bind.mobi("T", ["A"], text, 2, entries))]

    books = parse_files(files(talks(spark, sf_dir), make))
    anchors = F.regexp_extract_all(F.col("sections")[0]["html"], F.lit('<a id="fp[0-9]+"></a>'), F.lit(0))
    rows = books.select(number().alias("conv_id"), anchors.alias("anchors"), F.inline("toc"))
    mine = F.array_position("anchors", F.concat(F.lit('<a id="'), F.col("fragment"), F.lit('"></a>')))
    return rows.select("conv_id", "entry_idx", "parent_idx", "title", F.md5(F.array_join(F.slice("anchors", F.lit(1), mine.cast("int")), "")).alias("anchors_md5"))


def chms(spark, sf_dir) -> DataFrame:
    """The first topic of each stands in an LZX frame if it fits one."""

    def make(r: dict) -> list[tuple[str, bytes]]:
        topics = {f"/t{x['turn']}.html": bind.page(x["role"], x["text"]).encode() for x in r["turns"]}
        first = next(iter(topics))
        packed = {first: topics.pop(first)} if len(topics[first]) <= 32768 else {"/empty.css": b" "}
        return [(f"h{r['conv_id']}.chm", bind.chm(topics | {"/s.css": b"css"}, packed, f"Talk {r['conv_id']}", first[1:]))]

    return parse_files(files(talks(spark, sf_dir), make))


@query("chm_topics", f"SELECT conv_id, 't' || turn || '.html' AS source_path, role AS title, md5('<h1>' || role || '</h1><p>' || {_XML.format('text')} || '</p>') AS html_md5 FROM conversations")
def chm_topics(spark, sf_dir):
    return rows_of(chms(spark, sf_dir), "sections").select(number("book").alias("conv_id"), "source_path", "title", F.md5("html").alias("html_md5"))


@query("chm_system", f"SELECT conv_id, 'Talk ' || conv_id AS title, 't' || turn || '.html' AS first_topic, n AS n_sections FROM ({_TALK})")
def chm_system(spark, sf_dir):
    """Title and default topic, which comes first."""
    return chms(spark, sf_dir).select(number().alias("conv_id"), "title", F.col("sections")[0]["source_path"].alias("first_topic"), F.size("sections").cast("long").alias("n_sections"))


def notes(spark, sf_dir) -> DataFrame:
    def make(r: dict) -> list[tuple[str, bytes]]:
        text = f"---\ntitle: \"{r['p_name']}\"\nauthor: {r['p_brand']}\n---\n# One\n\n## {r['p_size']} x\n## {r['p_size']} x\n\n* [ ] size {r['p_size']}\n* [x] **made** ~~once~~\n\n| a | b |\n|---|---|\n| q | {r['p_size']} |\n\n> see https://x.org/{r['p_partkey']} now\n\n```sh\na < {r['p_size']}\n```\n"
        return [(f"n{r['p_partkey']}.md", text.encode())]

    return parse_files(files(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), make))


@query("markdown_books", """SELECT p_partkey, p_name AS title, p_brand AS author, md5('<h1 id="one">One</h1>' || chr(10) || '<h2 id="' || p_size || '-x">' || p_size || ' x</h2>' || chr(10) || '<h2 id="' || p_size || '-x-1">' || p_size || ' x</h2>' || chr(10)
|| '<ul><li><input type="checkbox" disabled> size ' || p_size || '</li><li><input type="checkbox" disabled checked> <strong>made</strong> <del>once</del></li></ul>' || chr(10)
|| '<table><tr><th>a</th><th>b</th></tr><tr><td>q</td><td>' || p_size || '</td></tr></table>' || chr(10)
|| '<blockquote><p>see <a href="https://x.org/' || p_partkey || '">https://x.org/' || p_partkey || '</a> now</p></blockquote>' || chr(10)
|| '<pre><code class="language-sh">a &lt; ' || p_size || chr(10) || '</code></pre>') AS html_md5 FROM part""")
def markdown_books(spark, sf_dir):
    return notes(spark, sf_dir).select(number().alias("p_partkey"), "title", "author", F.md5(F.col("sections")[0]["html"]).alias("html_md5"))


@query("book_errors", """SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'This book could not be read' WHEN 1 THEN 'Cannot open this book' WHEN 2 THEN 'Unsupported book type' WHEN 3 THEN 'This book is encrypted' END AS summary FROM pages""")
def book_errors(spark, sf_dir):
    """Pages under names that they are no files of, and what a reader says of them."""

    def make(r: dict) -> list[tuple[str, bytes]]:
        kind, n, page = r["page_id"] % 5, r["page_id"], (r["html"] or "").encode()
        if kind == 3:
            locked = bytearray(bind.mobi("T", ["A"], b"text"))
            start = int.from_bytes(locked[78:82], "big")
            locked[start + 12 : start + 14] = b"\0\1"
            return [(f"b{n}.mobi", bytes(locked))]
        return [(f"b{n}.{('fb2', 'epub', 'txt', '', 'md')[kind]}", b"<a>" if kind == 0 else page)]

    found = parse_files(files(table(spark, sf_dir, "pages"), make), resources=False)
    return found.select(number().alias("page_id"), T.error_summary(F.col("parse_error")).alias("summary"))


# Column functions that stand in front of the readers


@query("charset_chain", "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents")
def charset_chain(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    declared = F.when(F.col("doc_id") % 3 == 0, "utf-8").when(F.col("doc_id") % 3 == 1, "no-such-charset")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.decode_bytes(F.to_binary(text, F.lit("utf-8")), declared)).alias("text_md5"))


@query("front_matter", "SELECT doc_id, nullif(source, '') AS title, CASE WHEN doc_id % 2 = 0 THEN nullif(lang, '') END AS author, md5(text) AS body_md5 FROM documents WHERE text IS NOT NULL")
def front_matter(spark, sf_dir):
    author = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("author: "), F.coalesce("lang", F.lit("")), F.lit("\n"))).otherwise(F.lit("other: x\n"))
    text = F.concat(F.lit('---\ntitle: "'), F.coalesce("source", F.lit("")), F.lit('"\n'), author, F.lit("---\n"), F.col("text"))
    found = T.front_matter(text)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", found["title"].alias("title"), found["author"].alias("author"), F.md5(found["body"]).alias("body_md5"))


@query("fence_classes", "SELECT doc_id, [CASE doc_id % 4 WHEN 0 THEN 'mermaid' WHEN 1 THEN 'math' ELSE 'code' END, 'code'] AS classes FROM documents")
def fence_classes(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Mermaid", "latex", "python", ""))), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("a\n```"), name, F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), "[`~]", "'"), F.lit("\n```\nb\n~~~ sh\n"), F.col("source"))
    return table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit(""))).select("doc_id", T.fence_classes(text).alias("classes"))


@query("embedded_pictures", """SELECT doc_id, '<img src="mobi/' || (doc_id % 32) || '"> <img src="mobi/' || (doc_id % 999) || '"> mobi/' || (doc_id % 1000) AS html FROM documents""")
def embedded_pictures(spark, sf_dir):
    n = F.col("doc_id") % 32 + 1  # base 32, from 1
    code = F.concat(F.lit("000"), F.substring(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUV"), (n % 32 + 1).cast("int"), F.lit(1)))
    code = F.when(n == 32, "0010").otherwise(code)
    html = F.concat(F.lit('<img src="kindle:embed:'), code, F.lit('?mime=image/jpg"> <img recindex="'), F.lpad((F.col("doc_id") % 999 + 1).cast("string"), 5, "0"), F.lit('"> resource'), F.lpad((F.col("doc_id") % 1000).cast("string"), 5, "0"), F.lit(".jpg"))
    return table(spark, sf_dir, "documents").select("doc_id", T.embedded_pictures(html).alias("html"))


@query("traversal_guard", "SELECT page_id, page_id % 4 IN (0, 3) AS inside FROM pages")
def traversal_guard(spark, sf_dir):
    path = F.element_at(F.array(F.lit("a/b.png"), F.lit("../b.png"), F.lit("a/../../root2/b"), F.lit("/root/a//./b")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", L.inside(path, F.lit("root")).alias("inside"))


@query("ledger_upsert", LEDGER)
def ledger_upsert(spark, sf_dir):
    """Two ledgers, the newer upserted into the older, as a stream's batches are."""
    rows = events(spark, sf_dir)
    half = rows.agg(F.percentile_approx("ts", 0.5)).first()[0] or 0
    return merged(P.ledger(rows.where(F.col("ts") <= half)), P.ledger(rows.where(F.col("ts") > half)))
