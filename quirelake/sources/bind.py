"""Books made of rows: the bytes of small EPUB, FB2, MOBI, CHM, DjVu and comic files."""

from __future__ import annotations

import base64
import io
import struct
import tarfile
import zipfile
from html import escape


def zipped(files: dict[str, bytes | str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def tarred(files: dict[str, bytes], old: bool = False) -> bytes:
    """A tar; an old one has no magic number, so only the checksum of its headers tells it."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    made = bytearray(out.getvalue())
    if old:
        at = 0
        for data in files.values():
            made[at + 257 : at + 265] = bytes(8)
            head = made[at : at + 512]
            made[at + 148 : at + 156] = b"%06o\0 " % (sum(head[:148]) + 8 * 32 + sum(head[156:]))
            at += 512 + -(-len(data) // 512) * 512
    return bytes(made)


def picture(kind: str, width: int, height: int) -> bytes:
    """The header of a picture without its pixels."""
    if kind == "png":
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height)
    if kind == "gif":
        return b"GIF89a" + struct.pack("<HH", width, height)
    if kind == "bmp":
        return b"BM" + bytes(16) + struct.pack("<ii", width, height)
    return b"\xff\xd8\xff\xc0\x00\x11\x08" + struct.pack(">HH", height, width) + bytes(12)


def page(role: str, text: str, ident: str | None = None) -> str:
    mark = f' id="{ident}"' if ident else ""
    return f"<html><head><title>{escape(role)}</title></head><body{mark}><h1>{escape(role)}</h1><p>{escape(text, quote=False)}</p></body></html>"


def epub(number: int, turns: list[dict], ncx: bool, container: bool) -> bytes:
    """A chapter for each turn; contents as NCX or nav, two entries a chapter. The spine also names what is not there, and a picture."""
    items = "".join(f'<item id="t{x["turn"]}" href="text/t%20{x["turn"]}.xhtml" media-type="application/xhtml+xml"/>' for x in turns)
    refs = "".join(f'<itemref idref="t{x["turn"]}"/>' for x in turns)
    path = "text/t%20{0}.xhtml"
    if ncx:
        points = "".join(f'<navPoint><navLabel><text>{x["role"]} {x["turn"]}</text></navLabel><content src="{path.format(x["turn"])}"/><navPoint><navLabel><text>end</text></navLabel><content src="{path.format(x["turn"])}#b{x["turn"]}"/></navPoint></navPoint>' for x in turns)
        contents = ("toc.ncx", f'<ncx xmlns="n"><navMap>{points}</navMap></ncx>', '<item id="toc" href="toc.ncx" media-type="application/x-dtbncx+xml"/>')
    else:
        points = "".join(f'<li><a href="{path.format(x["turn"])}">{x["role"]} {x["turn"]}</a><ol><li><a href="{path.format(x["turn"])}#b{x["turn"]}">end</a></li></ol></li>' for x in turns)
        contents = ("nav.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{points}</ol></nav></body></html>', '<item id="toc" href="nav.xhtml" properties="nav"/>')
    opf = f"""<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Talk {number}</dc:title>
<dc:creator>{turns[0]["role"]} &amp; others</dc:creator><dc:language>en</dc:language><dc:identifier>id{number}</dc:identifier><meta name="cover" content="p"/></metadata>
<manifest>{items}{contents[2]}<item id="p" href="p.png" media-type="image/png"/></manifest><spine toc="{"toc" if ncx else ""}">{refs}<itemref idref="gone"/><itemref idref="p"/></spine></package>"""
    files = {"OEBPS/p.opf": opf, f"OEBPS/{contents[0]}": contents[1], "OEBPS/p.png": picture("png", 7, 9)}
    files |= {f"OEBPS/text/t {x['turn']}.xhtml": page(x["role"], x["text"], f"b{x['turn']}") for x in turns}
    if container:
        files["META-INF/container.xml"] = '<container><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>'
    return zipped(files)


def fb2(number: int, turns: list[dict], charset: str | None) -> bytes:
    """A section for each turn and the first text as a picture's bytes. charset is declared; without one the text is windows-1251 bytes of a Russian title, undeclared."""
    sections = "".join(f'<section><title><p>{x["role"]}</p></title><p>{escape(x["text"])}</p></section>' for x in turns) if charset else ""
    title = f"Talk {number}" if charset else f"Книга {number}"
    declared = f' encoding="{charset}"' if charset else ""
    data = base64.b64encode(turns[0]["text"].encode()).decode()
    book = f"""<?xml version="1.0"{declared}?><FictionBook xmlns="f" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><author><first-name>{turns[0]["role"]}</first-name><last-name>Z</last-name></author><author><nickname>N</nickname></author>
<book-title> Talk  of </book-title><lang>en</lang><coverpage><image l:href="#c.jpg"/></coverpage></title-info><document-info><author><nickname>X</nickname></author><id>{title}</id></document-info></description><body>{sections}</body><binary id="c.jpg" content-type="image/jpeg">{data}</binary></FictionBook>"""
    return book.encode(charset if charset and charset != "unknown-8" else "utf-8" if charset else "windows-1251", "xmlcharrefreplace")


def palmdoc(data: bytes) -> bytes:
    """Packed without copies: literals, and runs of up to eight bytes where a byte would mean something else."""
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at]
        if c == 0x20 and at + 1 < len(data) and 0x40 <= data[at + 1] < 0x80:
            out.append(data[at + 1] ^ 0x80)
            at += 2
        elif c == 0 or 9 <= c < 0x80:
            out.append(c)
            at += 1
        else:
            run = data[at : at + 8]
            out.append(len(run))
            out += run
            at += len(run)
    return bytes(out)


def coded(data: bytes) -> bytes:
    """Text in codes of eight bits for single bytes, but runs of two spaces in one for a phrase of two codes."""
    return bytes(255 - x for x in data.replace(b"  ", b"\0"))


def code_tables() -> list[bytes]:
    """The records that say so: phrase 0 is two codes for a space."""
    tables = b"HUFF" + struct.pack(">III", 24, 24, 24 + 1024) + bytes(8) + struct.pack(">256I", *[255 << 8 | 128 | 8] * 256) + struct.pack(">64I", *[0, 0] * 32)
    phrases = [struct.pack(">H", 2) + bytes([255 - 32] * 2), *(struct.pack(">H", 0x8001) + bytes([x]) for x in range(1, 256))]
    starts, at = [], 512
    for x in phrases:
        starts.append(at)
        at += len(x)
    return [tables, b"CDIC" + struct.pack(">III", 16, 256, 8) + struct.pack(">256H", *starts) + b"".join(phrases)]


def _ends_with_bit(n: int) -> bytes:
    out = [n & 0x7F | 0x80]
    while n := n >> 7:
        out.append(n & 0x7F)
    return bytes(reversed(out))


def contents_index(entries: list[tuple[str, int, int | None]]) -> list[bytes]:
    """An index of (title, byte offset, parent): its head, its entries, and their labels."""
    labels, rows = b"", []
    for k, (title, offset, parent) in enumerate(entries):
        name, label = b"%04d" % k, title.encode()
        tail = _ends_with_bit(offset) + _ends_with_bit(len(labels)) + (_ends_with_bit(parent) if parent is not None else b"")
        rows.append(bytes([len(name)]) + name + bytes([7 if parent is not None else 3]) + tail)
        labels += _ends_with_bit(len(label)) + label
    tagx = b"TAGX" + struct.pack(">II", 28, 1) + bytes([1, 1, 1, 0, 3, 1, 2, 0, 21, 1, 4, 0, 0, 0, 0, 1])
    head = bytearray(192)
    head[:4], head[4:8], head[24:28], head[52:56] = b"INDX", struct.pack(">I", 192), struct.pack(">I", 1), struct.pack(">I", 1)
    data, starts, at = bytearray(192), [], 192
    for x in rows:
        starts.append(at)
        at += len(x)
    data[:4], data[4:8], data[20:24], data[24:28] = b"INDX", struct.pack(">I", 192), struct.pack(">I", at), struct.pack(">I", len(rows))
    return [bytes(head) + tagx, bytes(data) + b"".join(rows) + b"IDXT" + b"".join(struct.pack(">H", x) for x in starts), labels]


def mobi(title: str, authors: list[str], text: bytes, packing: int = 1, entries: list[tuple[str, int, int | None]] = (), size: int = 4096) -> bytes:
    """packing is 1 for plain text, 2 for PalmDOC, 17480 for phrase codes."""
    pack = {1: bytes, 2: palmdoc, 17480: coded}[packing]
    parts = [pack(text[k : k + size]) for k in range(0, len(text), size)]
    exth = b"".join(struct.pack(">II", k, len(v.encode()) + 8) + v.encode() for k, v in [*((100, x) for x in authors), (503, title), (524, "en")])
    extra = b"EXTH" + struct.pack(">II", 12 + len(exth), len(authors) + 2) + exth
    pictures, tables, listing = [picture("jpg", 3, 4)], code_tables() if packing == 17480 else [], contents_index(list(entries)) if entries else []
    first = len(parts) + 1
    head = bytearray(16 + 232)
    head[:16] = struct.pack(">HHIHHHH", packing, 0, len(text), len(parts), size, 0, 0)
    head[16:32] = b"MOBI" + struct.pack(">III", 232, 2, 65001)
    head[84:92] = struct.pack(">II", 248 + len(extra), 4)
    head[108:112] = struct.pack(">I", first + len(tables) + len(listing))
    head[112:120] = struct.pack(">II", first, len(tables)) if tables else bytes(8)
    head[128:132] = struct.pack(">I", 0x40)
    head[244:248] = struct.pack(">I", first + len(tables) if listing else 0xFFFFFFFF)
    whole = [bytes(head) + extra + b"Full", *parts, *tables, *listing, *pictures]
    out, at = bytearray(60) + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(whole)), 78 + 8 * len(whole) + 2
    for r in whole:
        out += struct.pack(">II", at, 0)
        at += len(r)
    return bytes(out) + b"\0\0" + b"".join(whole)


def iff(name: bytes, payload: bytes) -> bytes:
    return name + struct.pack(">I", len(payload)) + payload + b"\0" * (len(payload) % 2)


def hidden_text(words: list[str]) -> bytes:
    """A text chunk of one page of 1000 x 800 with one line of words, each ten units a letter."""
    text = " ".join(words).encode()

    def zone(kind: int, x: int, y: int, w: int, h: int, start: int, length: int, below: int) -> bytes:
        return bytes([kind]) + struct.pack(">5H", *(v + 0x8000 for v in (x, y, w, h, start))) + length.to_bytes(3, "big") + below.to_bytes(3, "big")

    found = [zone(6, 5 if k else 0, 0, 10 * len(x), 30, 1 if k else 0, len(x), 0) for k, x in enumerate(words)]
    return len(text).to_bytes(3, "big") + text + b"\1" + zone(1, 0, 0, 1000, 800, 0, len(text), 1) + zone(5, 10, 20, 500, 30, 0, len(text), len(words)) + b"".join(found)


def djvu(pages: list[tuple[int, int, int]], title: str, author: str, words: list[list[str]] = ()) -> bytes:
    """Pages of (width, height, dpi) without pixels, with metadata in a plain annotation and words as hidden text."""
    note = iff(b"ANTa", f'(metadata (Title "{title}") (author "{author}"))'.encode())
    forms = [iff(b"FORM", b"DJVU" + iff(b"INFO", struct.pack(">HH", w, h) + b"\x18\0" + struct.pack("<H", dpi) + b"\x16\0") + (note if not i else b"") + (iff(b"TXTa", hidden_text(words[i])) if words else b"")) for i, (w, h, dpi) in enumerate(pages)]
    return b"AT&T" + (forms[0] if len(forms) == 1 else iff(b"FORM", b"DJVM" + iff(b"DIRM", b"\x81\0\0") + b"".join(forms)))


class Bits:
    """Bits in 16-bit little-endian words, highest first."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value, self.n = self.value << n | value, self.n + n

    def words(self) -> bytes:
        pad = -self.n % 16
        out = (self.value << pad).to_bytes((self.n + pad) // 8, "big")
        return b"".join(out[k : k + 2][::-1] for k in range(0, len(out), 2))


def lzx_stored(data: bytes) -> bytes:
    """One LZX block of bytes as they are, up to a frame long."""
    w = Bits()
    w.put(0, 1), w.put(3, 3), w.put(len(data), 24), w.put(0, 4)
    return w.words() + struct.pack("<III", 1, 1, 1) + data


def _length(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def chm(files: dict[str, bytes], packed: dict[str, bytes], title: str, first: str) -> bytes:
    """files stand as they are; packed lie in one LZX frame of at most 32 KiB."""
    system = b"\3\0\0\0" + b"".join(struct.pack("<HH", k, len(v)) + v for k, v in ((2, first.encode() + b"\0"), (3, title.encode() + b"\0")))
    whole = b"".join(packed.values())
    content = lzx_stored(whole)
    control = struct.pack("<I4sIIIII", 6, b"LZXC", 2, 1, 1, 0, 0)
    reset = struct.pack("<IIIIQQQQ", 2, 1, 8, 0x28, len(whole), len(content), 32768, 0)
    space = "::DataSpace/Storage/MSCompressed/"
    plain = {space + "ControlData": control, space + "Transform/x/InstanceData/ResetTable": reset, space + "Content": content, "/#SYSTEM": system, **files}
    blob, entries, at = b"", [], 0
    for name, data in plain.items():
        entries.append((name, 0, len(blob), len(data)))
        blob += data
    for name, data in packed.items():
        entries.append((name, 1, at, len(data)))
        at += len(data)
    listing = b"".join(_length(len(n.encode())) + n.encode() + _length(s) + _length(a) + _length(z) for n, s, a, z in entries)
    block = 0x14 + len(listing)
    chunk = b"PMGL" + struct.pack("<I", 0) + b"\0" * 12 + listing
    itsp = (b"ITSP" + struct.pack("<IIIIIIiii", 1, 0x54, 10, block, 2, 1, -1, 0, 0)).ljust(0x54, b"\0")
    head = (b"ITSF" + struct.pack("<I", 3)).ljust(0x48, b"\0") + struct.pack("<QQQ", 0x60, 0x54 + block, 0x60 + 0x54 + block)
    return head + itsp + chunk + blob
