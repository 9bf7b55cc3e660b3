import base64
import io
import random
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quirelake.sources import chm, comic, djvu, epub, fb2, images, lzx, markdown, mobi, reader
from quirelake.sources.model import ParseError


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(files, **more):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", **more) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> T &amp; U </dc:title><dc:creator>A</dc:creator>
<dc:language>en</dc:language><dc:identifier>id1</dc:identifier><meta name="cover" content="c"/></metadata><manifest><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" %s/>
<item id="x" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="a" href="text/a%%20b.xhtml"/><item id="b" href="text/c.html"/><item id="p" href="p.png" media-type="image/png"/></manifest>
<spine toc="x"><itemref idref="b"/><itemref idref="gone"/><itemref idref="a"/><itemref idref="p"/></spine></package>"""
NAV = """<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="z">no</a></li></ol></nav>
<nav epub:type="toc"><ol><li><a href="text/c.html#%C3%A9">One</a><ol><li><span>Two</span></li></ol></li><li><a href="#s">Three</a></li></ol></nav></body></html>"""
NCX = """<ncx xmlns="n"><navMap><navPoint><navLabel><text>N1</text></navLabel><content src="text/c.html"/><navPoint><navLabel><text>N2</text></navLabel><content src="text/a%20b.xhtml#k"/></navPoint></navPoint></navMap></ncx>"""


def book_files(nav=True, container=True):
    files = {"OEBPS/p.opf": OPF % ('properties="nav"' if nav else ""), "OEBPS/nav.xhtml": NAV, "OEBPS/toc.ncx": NCX, "OEBPS/text/a b.xhtml": "<html><body id='k'>second</body></html>", "OEBPS/text/c.html": "<body>first</body>", "OEBPS/p.png": b"png"}
    if container:
        files["META-INF/container.xml"] = '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
    return files


def test_epub():
    for container in (True, False):
        b = epub.parse(zipped(book_files(container=container)), "x.epub")
        assert (b.title, b.author, b.language, b.identifier, b.cover_path) == ("T & U", "A", "en", "id1", "c")
        assert [(s[0], s[2], s[4]) for s in b.sections] == [("OEBPS/text/c.html", None, "first"), ("OEBPS/text/a b.xhtml", "k", "second")]
        assert b.toc == [(None, 0, "One", "OEBPS/text/c.html", "é"), (0, 1, "Two", None, None), (None, 0, "Three", None, "s")]
        assert ("OEBPS/p.png", "image/png", b"png") in b.resources
    assert [e[:3] for e in epub.parse(zipped(book_files(nav=False)), "x").toc] == [(None, 0, "N1"), (0, 1, "N2")]
    assert len(epub.parse(zipped(book_files()), "x", 1).sections) == 1
    for bad in (b"no", zipped({"a": b""}), zipped({"p.opf": "<package><broken>"})):
        with pytest.raises(ParseError):
            epub.parse(bad, "x")


FB2 = """<?xml version="1.0" encoding="%s"?><FictionBook xmlns="f" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><author><first-name>Лев</first-name><last-name>Т.</last-name></author>
<author><nickname>N</nickname></author><book-title>Книга</book-title><lang>ru</lang><coverpage><image l:href="#c.jpg"/></coverpage></title-info><document-info><author><nickname>X</nickname></author><id>42</id></document-info></description>
<body><section><title><p>A</p><p>B</p></title><p>x &amp; <emphasis>y</emphasis></p><empty-line/><epigraph><title><p>q</p></title></epigraph><section><title><p>C</p></title><p>z<a l:href="#n1" type="note">1</a></p></section></section></body>
<body name="notes"><section id="n1"><p>note</p></section></body><binary id="c.jpg" content-type="image/jpeg">%s</binary></FictionBook>"""


def test_fb2():
    for charset in ("utf-8", "windows-1251"):
        b = fb2.parse((FB2 % (charset, base64.b64encode(b"jpg").decode())).encode(charset), "x.fb2")
        assert (b.title, b.author, b.language, b.identifier, b.cover_path) == ("Книга", "Лев Т., N", "ru", "42", "c.jpg")
        assert b.resources == [("c.jpg", "image/jpeg", b"jpg")]
    html = b.sections[0][4]
    assert '<h1>A<br>B</h1><p>x &amp; <em>y</em></p><div class="fb2-empty-line"></div>' in html
    assert '<p class="fb2-minor-title">q</p>' in html and "<h2>C</h2>" in html and 'class="fb2-note-ref" href="#n1"' in html
    assert '<div class="fb2-body-break"></div><div class="fb2-section" id="n1">' in html
    assert not b.toc_is_fallback
    assert "<p>note" not in fb2.parse((FB2 % ("utf-8", "")).encode(), "x", 1).sections[0][4]
    with pytest.raises(ParseError):
        fb2.parse(b"<FictionBook>", "x")


PNG = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9)


def test_images():
    exif = b"Exif\0\0MM\0*\0\0\0\x08" + struct.pack(">HHHIHH", 1, 0x0112, 3, 1, 6, 0)
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\0" * 12
    plain = b"\xff\xd8\xff\xc2\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\0" * 12
    assert images.size(PNG) == (7, 9) and images.size(jpeg) == (20, 30) and images.size(plain) == (30, 20)
    assert images.size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4)
    assert images.size(b"BM" + b"\0" * 16 + struct.pack("<ii", 5, -6)) == (5, 6)
    assert images.size(b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x09\0\0\x13\0\0") == (10, 20)
    assert images.size(b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 5 + struct.pack("<I", 9 | 19 << 14)) == (10, 20)
    assert images.size(b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 11, 12)) == (11, 12)
    assert images.size(b"\x89PNG") == images.size(b"") == (0, 0)


def test_comics():
    info = b"<ComicInfo><Series>S</Series><Number>3</Number><Writer> W </Writer><Pages><Page Image='1' Bookmark='mid'/><Page image='P10.PNG' bookmark='end'/><Page Image='9' Bookmark='no'/></Pages></ComicInfo>"
    files = {"p10.png": PNG, "p9.png": PNG, "__MACOSX/p1.png": b"", "d/._x.png": b"", "readme.txt": b"", "ComicInfo.xml": info}
    for content in (zipped(files), tarred(files), tarred({"x" * 150 + "/" + k: v for k, v in files.items() if "MACOSX" not in k}, format=tarfile.GNU_FORMAT), tarred(files, format=tarfile.PAX_FORMAT)):
        b = comic.parse(content, "c.cbz")
        assert [p[1] for p in b.pages] == ["p9", "p10"] and b.pages[0][3:5] == (7, 9)
        assert (b.title, b.author) == ("S #3", "W") and b.bookmarks == [(1, "mid"), (1, "end")]
    assert [e[2] for e in comic.parse(zipped({"a/1.png": PNG, "b/2.png": PNG, "b/3.png": PNG}), "c").toc] == ["a", "1", "b", "2", "3"]
    for bad in (b"Rar!\x1a", b"what", zipped({"a.txt": b""})):
        with pytest.raises(ParseError):
            comic.parse(bad, "c")
    names = ["page10", "page9", "Page2", "a01", "a1b", "a0001", "x" + "9" * 30]
    assert sorted(names, key=comic.natural_key) == ["a01", "a0001", "a1b", "Page2", "page9", "page10", "x" + "9" * 30]


def test_markdown():
    b = markdown.parse(b"---\ntitle: 'T'\nauthor: A\n---\n# One\n\n## x\n## x\n\ntext *e* `a<b`\n", "d/f.md")
    assert (b.title, b.author) == ("T", "A")
    assert b.sections[0][4] == '<h1 id="one">One</h1>\n<h2 id="x">x</h2>\n<h2 id="x-1">x</h2>\n<p>text <em>e</em> <code>a&lt;b</code></p>'
    assert markdown.parse(b"# H <b>\n", "f.md").title == "H" and markdown.parse("é".encode("latin-1"), "a/f.md").title == "f"
    assert markdown.to_html("import x\n\ny", mdx=True) == "<p>y</p>" and "mermaid" in markdown.to_html("```mermaid\na\n```")


def test_more_markdown():
    h = markdown.to_html
    assert h("- a\n  - b\n  - c\n- d") == "<ul><li>a\n<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>"
    assert h("3. x\n4. y\n\ntext") == '<ol start="3"><li>x</li><li>y</li></ol>\n<p>text</p>'
    assert h("* a\n  more\n\n  para\n* b") == "<ul><li>a more\n<p>para</p></li><li>b</li></ul>"
    assert h("- a\n1. b") == "<ul><li>a</li></ul>\n<ol><li>b</li></ol>"
    assert h("Title\n===\n\nSub *x*\n---\ntext") == '<h1 id="title">Title</h1>\n<h2 id="sub-x">Sub <em>x</em></h2>\n<p>text</p>'
    assert h("a  \nb\\\nc\nd") == "<p>a<br>\nb<br>\nc\nd</p>"
    assert h(r"\*no\* 1\. \< *yes*") == "<p>*no* 1. &lt; <em>yes</em></p>"
    assert h("see [the *x*][One] and [two][] and [three] [none]\n\n[one]: /a 'T'\n[Two]: <http://b>\n[three]: c") == '<p>see <a href="/a">the <em>x</em></a> and <a href="http://b">two</a> and <a href="c">three</a> [none]</p>'
    assert h("|a|b|c|\n|:-|:-:|-:|\n|1|2 \\| 3|\n\nx") == '<table><tr><th align="left">a</th><th align="center">b</th><th align="right">c</th></tr><tr><td align="left">1</td><td align="center">2 | 3</td><td align="right"></td></tr></table>\n<p>x</p>'
    assert h("    code <b>\n\n    more\n\ntext") == "<pre><code>code &lt;b&gt;\n\nmore\n</code></pre>\n<p>text</p>"
    assert h("- a\n\n  ```sh\n  x\n  ```\n- b") == '<ul><li>a\n<pre><code class="language-sh">x\n</code></pre></li><li>b</li></ul>'
    assert h("mail <https://x.y/z> at www.q.org.") == '<p>mail <a href="https://x.y/z">https://x.y/z</a> at <a href="http://www.q.org">www.q.org</a>.</p>'
    assert h("-\n- ") and h("1)\n") and h("* * *") == "<hr>"


def test_markdown_ends_on_any_input():
    """Zero bytes stand for nothing of ours, and any mix of marks comes to an end."""
    assert markdown.to_html("[a]: b\0\n\n[a] \0 0") == '<p><a href="b\ufffd">a</a> \ufffd 0</p>'
    r = random.Random(1)
    marks = ["- ", "* ", "1. ", "  ", "    ", "\n", "\n\n", "> ", "# ", "```", "|", "|-|-|", "[a]", "[a]: b", "(c)", "<b>", "x", "\\", "**", "_", "`", "$", "===", "---", "\0"]
    for _ in range(3000):
        markdown.to_html("".join(r.choice(marks) for _ in range(r.randint(0, 25))))


def iff(name, payload):
    return name + struct.pack(">I", len(payload)) + payload + b"\0" * (len(payload) % 2)


def test_djvu():
    info = iff(b"INFO", struct.pack(">HH", 100, 200) + b"\x18\0" + struct.pack("<H", 400) + b"\x16\0")
    note = iff(b"ANTa", b'(metadata (title "A \\"q\\"") (Author "B"))')
    page = iff(b"FORM", b"DJVU" + info + note)
    b = djvu.parse(b"AT&T" + page, "x.djvu")
    assert b.pages == [("0", "1", None, 100, 200, 400)] and (b.title, b.author) == ('A "q"', "B")
    many = b"AT&T" + iff(b"FORM", b"DJVM" + iff(b"DIRM", b"\x81\0\0") + iff(b"FORM", b"DJVI" + iff(b"x   ", b"odd")) + page + iff(b"FORM", b"DJVU" + iff(b"INFO", struct.pack(">HH", 5, 6))))
    b = djvu.parse(many, "x")
    assert [p[3:] for p in b.pages] == [(100, 200, 400), (5, 6, 300)] and len(b.toc) == 2
    assert djvu.parse(b.resources[0][2], "y").pages[0][3:5] == (100, 200)
    for bad in (b"AT&TFORM", b"no", b"AT&T" + iff(b"FORM", b"DJVM" + iff(b"DIRM", b"\x01\0\0") + page), b"AT&T" + iff(b"FORM", b"DJVU")):
        with pytest.raises(ParseError):
            djvu.parse(bad, "x")
    pages = [("a", "n", "1st"), ("b", "m", "5")]
    assert [djvu.page_number(x, pages) for x in ("2", "n", "1st", "5", "9")] == [1, 0, 0, 1, None]
    made = djvu.Book("djvu")
    djvu.outline([("A", "#1", 2), ("B", "x#y#2", 0), ("C", "#", 0), ("D", "z", 0)], made)
    assert made.toc == [(None, 0, "A", None, "1"), (0, 1, "B", None, "2"), (0, 1, "C", None, None), (None, 0, "D", None, None)]


def test_hidden_text_zones():
    from quirelake.sources import bind

    text, rows = djvu.zones(bind.hidden_text(["one", "two", "three"]))
    assert text == "one two three" and [(r["kind"], r["parent_idx"], r["text"]) for r in rows] == [("page", None, text), ("line", 0, text), ("word", 1, "one"), ("word", 1, "two"), ("word", 1, "three")]
    assert [(r["xmin"], r["xmax"]) for r in rows[2:]] == [(10, 40), (45, 75), (80, 130)]
    assert djvu.zones(b"\0\0\2ab") == ("ab", []) and djvu.zones(b"") == ("", [])
    for bad in (b"\0\0\0\1\x09" + bytes(16), b"\0\0\0\1\x01"):
        with pytest.raises(ParseError):
            djvu.zones(bad)


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]

    def words(self):
        bits = self.bits + [0] * (-len(self.bits) % 16)
        return b"".join(int("".join(map(str, bits[i : i + 16])), 2).to_bytes(2, "little") for i in range(0, len(bits), 16))


def lzx_block(data, matches=False):
    """A verbatim block of literals of nine bits, or one that also repeats its first ten bytes from ten back."""
    slots = len(lzx.slots(15))
    main = [9] * 256 + [0] * (8 * slots)
    if matches:
        main[256 + 8 * 7 + 7] = 1  # slot 7 starts at 12 and has two more bits; longer than eight bytes
    w = BitWriter()
    w.put(0, 1)
    w.put(lzx.VERBATIM, 3)
    w.put(len(data), 24)

    def lengths(values):
        """Each length on its own: codes of five bits for all 20 symbols of the first tree would not fill it, so lengths 4 and 5."""
        pre = [4] * 12 + [5] * 8
        for n in pre:
            w.put(n, 4)
        codes = {s: (n, c) for (n, c), s in lzx.canonical(pre).items()}
        for v in values:
            n, c = codes[-v % 17]
            w.put(c, n)

    lengths(main[:256])
    lengths(main[256:])
    length = [0] * 249
    if matches:
        length[1] = 1
    lengths(length)
    codes = {s: (n, c) for (n, c), s in lzx.canonical(main).items()}
    for x in data[:10] if matches else data:
        n, c = codes[x]
        w.put(c, n)
    if matches:
        n, c = codes[256 + 8 * 7 + 7]
        w.put(c, n)
        w.put(0, 1)  # ten bytes
        w.put(0, 2)  # position 12: ten back
    return w.words()


def stored_block(data):
    w = BitWriter()
    w.put(0, 1)
    w.put(lzx.STORED, 3)
    w.put(len(data), 24)
    w.put(0, 4)
    return w.words() + struct.pack("<III", 1, 1, 1) + data


def test_lzx():
    data = b"0123456789"
    assert lzx.Decoder(15).frame(lzx_block(data), len(data)) == data
    assert lzx.Decoder(15).frame(lzx_block(data * 2, True), 20) == data * 2
    assert lzx.Decoder(15).frame(stored_block(data), len(data)) == data
    assert [lzx.slots(b)[-1][0] < 1 << b for b in (15, 21)] == [True, True] and len(lzx.slots(15)) == 30 and len(lzx.slots(21)) == 50


def help_file(files, content, total):
    def word(n):
        out = [n & 0x7F]
        while n := n >> 7:
            out.append(n & 0x7F | 0x80)
        return bytes(reversed(out))

    control = struct.pack("<I4sIIIII", 6, b"LZXC", 2, 1, 1, 0, 0)
    reset = struct.pack("<IIIIQQQQ", 2, 1, 8, 0x28, total, len(content), 32768, 0)
    inner = {"::DataSpace/Storage/MSCompressed/ControlData": control, "::DataSpace/Storage/MSCompressed/Transform/x/InstanceData/ResetTable": reset, "::DataSpace/Storage/MSCompressed/Content": content}
    blob, entries = b"", b""
    for name, data in inner.items():
        entries += word(len(name)) + name.encode() + word(0) + word(len(blob)) + word(len(data))
        blob += data
    for name, (space, start, data) in files.items():
        if not space:
            start, blob = len(blob), blob + data
        entries += word(len(name)) + name.encode() + word(space) + word(start) + word(len(data))
    block = 0x14 + len(entries)
    chunk = b"PMGL" + struct.pack("<I", 0) + b"\0" * 12 + entries
    itsp = b"ITSP" + struct.pack("<IIIIIIiii", 1, 0x54, 10, block, 2, 1, -1, 0, 0)
    itsp = itsp.ljust(0x54, b"\0")
    head = b"ITSF" + struct.pack("<I", 3)
    head = head.ljust(0x48, b"\0") + struct.pack("<QQQ", 0x60, 0x54 + block, 0x60 + 0x54 + block)
    return head + itsp + chunk + blob


def test_chm():
    page = "<html><head><meta charset=gb2312><title>中</title></head><body>b文</body></html>".encode("gb18030")
    other = b"<html><h1>O</h1></html>"
    content = stored_block(page + other)
    system = b"\3\0\0\0" + struct.pack("<HH", 2, 6) + b"d/b.ht"[:5] + b"\0" + struct.pack("<HH", 3, 2) + b"T\0"
    files = {"/a.html": (1, 0, page), "/d/b.htm": (1, len(page), other), "/#SYSTEM": (0, 0, system), "/s.css": (0, 0, b"css"), "/$x.htm": (0, 0, b"")}
    b = chm.parse(help_file(files, content, len(page + other)), "x/y.chm")
    assert b.title == "T" and [(s[0], s[3]) for s in b.sections] == [("a.html", "中"), ("d/b.htm", "O")]
    assert b.sections[0][4] == "b文" and [e[2] for e in b.toc] == ["中", "d", "O"] and b.resources == [("s.css", None, b"css")]
    with pytest.raises(ParseError):
        chm.parse(b"ITSF" + b"\0" * 200, "x")


def mobi_file(records, text, packing=1, locked=0, flags=0, title=b"Full", exth=()):
    body = b"".join(struct.pack(">II", k, len(v) + 8) + v for k, v in exth)
    extra = b"EXTH" + struct.pack(">II", 12 + len(body), len(exth)) + body
    head = bytearray(16 + 232)
    head[:16] = struct.pack(">HHIHHHH", packing, 0, len(text), len(records), 4096, locked, 0)
    head[16:32] = b"MOBI" + struct.pack(">III", 232, 2, 65001)
    head[84:92] = struct.pack(">II", 248 + len(extra), len(title))
    head[108:112] = struct.pack(">I", len(records) + 1)
    head[128:132] = struct.pack(">I", 0x40)
    head[242:244] = struct.pack(">H", flags)
    whole = [bytes(head) + extra + title, *records, b"\xff\xd8\xffjpeg", b"FLIS"]
    start = 78 + 8 * len(whole) + 2
    out, at = bytearray(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(whole)), start
    for r in whole:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"\0\0" + b"".join(whole)


def test_mobi():
    text = "<html><head><guide></guide></head><body><h1>Å</h1><p>one <a filepos=0000000060>go</a></p><img recindex='00001'/></body></html>".encode()
    exth = [(100, b"A"), (100, b"B"), (503, b"Title"), (524, b"en"), (113, b"id")]
    b = mobi.parse(mobi_file([text[:50], text[50:]], text, exth=exth), "x.mobi")
    assert (b.title, b.author, b.language, b.identifier) == ("Title", "A, B", "en", "id")
    at = mobi.place(text, 60)
    want = text[:at] + b'<a id="fp60"></a>' + text[at:]
    want = want.replace(b"filepos=0000000060", b'href="#fp60"').replace(b"recindex='00001'", b'src="mobi/0"')
    assert b.sections[0][4].encode() == want[want.index(b"<h1>") : want.index(b"</body>")]
    assert b.resources == [("mobi/0", "image/jpeg", b"\xff\xd8\xffjpeg")]
    assert mobi.unpacked(b"ab\x03\0\x80\xff" + bytes([0x80 | 5 << 3 >> 8, (5 << 3 | 1) & 0xFF]) + bytes([0xC0 | ord("t") & 0x3F | 0x20])) == b"ab\0\x80\xffab\0\x80 t"
    assert mobi.trimmed(b"text" + b"\x01\xaa", 1) == b"text\x01\xaa"[: 6 - (0xAA & 3) - 1]
    assert mobi.trimmed(b"text" + b"zz\x83", 2) == b"text"
    assert mobi.parse(mobi_file([b"ab\xc1"], b"ab a", packing=2), "d/y.mobi").sections[0][4] == "ab A"
    for bad in (b"x", mobi_file([text], text, locked=2), mobi_file([text], text, packing=17480), mobi_file([text], text, packing=3)):
        with pytest.raises(ParseError):
            mobi.parse(bad, "x")


def test_bundles_and_unknown_entities(spark, tmp_path):
    for name, data in book_files().items():
        path = tmp_path / "u.epub" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())
    (tmp_path / "z.epub").write_bytes(zipped(book_files()))
    a, b = (r.asDict() for r in reader.read_books(spark, f"file://{tmp_path}").orderBy("path").collect())
    assert a["parse_error"] is None and {k: v for k, v in a.items() if k != "path"} == {k: v for k, v in b.items() if k != "path"}
    assert fb2.xml("<a>&nbsp;&nosuch;&amp;&#65;</a>").text == "\xa0&nosuch;&A"


def test_settings_are_written_where_they_can(spark, tmp_path):
    from quirelake.operators.upkeep import write_settings

    (tmp_path / "file").write_text("x")
    frame = spark.createDataFrame([("dark", 2)], "theme string, n int")
    done = write_settings(frame, [f"file://{tmp_path}/a", f"file://{tmp_path}/file/b", f"file://{tmp_path}/c"])
    assert done == [f"file://{tmp_path}/a", f"file://{tmp_path}/c"] and spark.read.json(f"file://{tmp_path}/a").first().theme == "dark"


def test_mobi_phrases_and_contents():
    from quirelake.sources import bind

    text = ("<h1>Å</h1>" + "a  b    c " * 900).encode()
    b = mobi.parse(bind.mobi("T", ["A"], text, 17480, [("One", 0, None), ("Two", 20, 0), ("Far", 10**6, None)]), "x.mobi")
    assert b.toc == [(None, 0, "One", None, "fp0"), (0, 1, "Two", None, "fp20"), (None, 0, "Far", None, None)] and b.toc_is_fallback
    html = b.sections[0][4]
    assert html.replace('<a id="fp0"></a>', "").replace('<a id="fp20"></a>', "").encode() == text and html.startswith('<a id="fp0"></a><h1>')
    tables = bind.code_tables()
    tables[1] = tables[1].replace(struct.pack(">H", 2) + bytes([223, 223]), struct.pack(">H", 2) + bytes([255, 255]))  # a phrase of itself
    with pytest.raises(ParseError):
        mobi.Huffman(tables[0], tables[1:]).unpacked(b"\xff")
    assert mobi.number(b"\x01\x82", 0) == (130, 2)


def test_read_books(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(zipped(book_files()))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.md").write_text("# B\ntext")
    (tmp_path / "c.CBT").write_bytes(tarred({"1.png": PNG}))
    (tmp_path / "d.epub").write_bytes(b"damaged")
    (tmp_path / "e.txt").write_text("x")
    (tmp_path / "f.mobi").write_bytes(b"x")
    books = reader.read_books(spark, f"file://{tmp_path}").cache()
    rows = {r.path.rpartition("/")[2]: r for r in books.collect()}
    assert {k: bool(r.parse_error) for k, r in rows.items()} == {"a.epub": False, "b.md": False, "c.CBT": False, "d.epub": True, "e.txt": True, "f.mobi": True}
    assert rows["c.CBT"].format == "cbz" and rows["b.md"].title == "B"
    sections = reader.rows_of(books, "sections")
    assert sections.where(F.col("book").endswith("a.epub")).count() == 2
    assert reader.resource(books, rows["a.epub"].path, "OEBPS/p.png").first().content == b"png"
    cards = reader.read_books(spark, f"file://{tmp_path}", thumbnails=True, glob="*.epub").collect()
    assert [len(r.sections or []) for r in sorted(cards, key=lambda r: r.path)] == [1, 0] and not any(r.resources for r in cards)
