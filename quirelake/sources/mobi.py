"""MOBI books after the public description of the Palm database: text, metadata, contents, links by offset, pictures.

Encrypted books are errors. The index of contents gives entries that stand behind headings found in the text.
"""

from __future__ import annotations

import re
import struct

from .common import decode, stem
from .model import Book, ParseError

#: Bytes of text that are kept, and how far before the cut a heading is looked for.
LIMIT, WINDOW = 8 << 20, 4000
PLAIN, PALMDOC, HUFFMAN = 1, 2, 17480
#: Entries of an index that are read.
ENTRIES = 800
# Tags of an entry of the index of contents.
OFFSET, LABEL, LEVEL, PARENT = 1, 3, 4, 21
# Metadata records, codecs, and magic numbers of pictures.
AUTHOR, ISBN, ASIN, TITLE, LANGUAGE = 100, 104, 113, 503, 524
CODECS = {1252: "cp1252", 65001: "utf-8"}
PICTURES = {b"\xff\xd8\xff": "image/jpeg", b"\x89PN": "image/png", b"GIF": "image/gif", b"BM": "image/bmp"}


def unpacked(b: bytes) -> bytes:
    """PalmDOC: literals, runs of them, copies of up to ten bytes, and a space with a letter."""
    out, i = bytearray(), 0
    while i < len(b):
        c = b[i]
        i += 1
        if 1 <= c <= 8:
            out += b[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(b):
            pair = (c << 8 | b[i]) & 0x3FFF
            i += 1
            distance = pair >> 3
            if not 0 < distance <= len(out):
                raise ParseError("damaged text record")
            for _ in range((pair & 7) + 3):
                out.append(out[-distance])
    return bytes(out)


class Huffman:
    """Text of codes of up to 32 bits for phrases, which may be packed themselves."""

    def __init__(self, tables: bytes, phrases: list[bytes]):
        if tables[:4] != b"HUFF" or any(x[:4] != b"CDIC" for x in phrases):
            raise ParseError("damaged code tables")
        near, far = struct.unpack(">II", tables[8:16])
        self.short = [(x & 31, x & 128, x >> 8) for x in struct.unpack(">256I", tables[near : near + 1024])]
        limits = struct.unpack(">64I", tables[far : far + 256])
        self.least = [0, *(limits[2 * n] << 31 - n for n in range(32))]
        self.most = [0, *((limits[2 * n + 1] + 1 << 31 - n) - 1 for n in range(32))]
        self.phrases: list[tuple[bytes, bool] | None] = []
        for x in phrases:
            count, bits = struct.unpack(">II", x[8:16])
            for (at,) in struct.iter_unpack(">H", x[16 : 16 + 2 * min(1 << bits, count - len(self.phrases))]):
                size = struct.unpack(">H", x[16 + at : 18 + at])[0]
                self.phrases.append((x[18 + at : 18 + at + (size & 0x7FFF)], bool(size & 0x8000)))

    def unpacked(self, b: bytes) -> bytes:
        out, whole, left = [], int.from_bytes(b + bytes(8), "big"), 8 * len(b)
        while left > 0:
            x = whole >> left + 32 & 0xFFFFFFFF
            n, ends, top = self.short[x >> 24]
            if not n:
                raise ParseError("damaged text record")
            if ends:
                most = (top + 1 << 32 - n) - 1
            else:
                while n < 32 and x < self.least[n]:
                    n += 1
                most = self.most[n]
            left -= n
            if left < 0:
                break
            k = most - x >> 32 - n
            if k >= len(self.phrases) or self.phrases[k] is None:
                raise ParseError("damaged text record")
            phrase, plain = self.phrases[k]
            if not plain:
                self.phrases[k] = None  # a phrase that holds itself is an error
                phrase = self.unpacked(phrase)
                self.phrases[k] = (phrase, True)
            out.append(phrase)
        return b"".join(out)


def number(b: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the last of which has the eighth, and the place behind it."""
    value = 0
    while at < len(b):
        value, at = value << 7 | b[at] & 0x7F, at + 1
        if b[at - 1] & 0x80:
            break
    return value, at


def index(records: list[bytes], first: int) -> tuple[list[dict[int, list[int]]], list[bytes]]:
    """Tag values of each entry of the index that starts at a record, and the records of its labels."""
    if first >= len(records) or records[first][:4] != b"INDX":
        return [], []
    head = records[first]

    def u32(b: bytes, at: int) -> int:
        return struct.unpack(">I", b[at : at + 4])[0] if at + 4 <= len(b) else 0

    at, count = u32(head, 4), u32(head, 24)
    if head[at : at + 4] != b"TAGX":
        return [], []
    size, controls = u32(head, at + 4), u32(head, at + 8)
    tags = [tuple(head[k : k + 4]) for k in range(at + 12, at + size, 4)]
    rows = []
    for b in records[first + 1 : first + 1 + count]:
        table, n = u32(b, 20), u32(b, 24)
        starts = [struct.unpack(">H", b[table + 4 + 2 * k : table + 6 + 2 * k])[0] for k in range(n)]
        for a, z in zip(starts, [*starts[1:], table], strict=True):
            entry = b[a:z]
            at = 1 + entry[0] if entry else 0
            flags, at, row, control, plan = entry[at : at + controls], at + controls, {}, 0, []
            for tag, each, mask, ends in tags:
                if ends & 1:
                    control += 1
                elif control < len(flags) and (value := flags[control] & mask):
                    if value == mask and mask & mask - 1:  # all bits: the size in bytes stands in the entry
                        size, at = number(entry, at)
                        plan.append((tag, None, size))
                    else:
                        plan.append((tag, (value // (mask & -mask)) * each, None))
            for tag, n, size in plan:
                end, found = at + size if n is None else None, []
                while at < len(entry) and (at < end if n is None else len(found) < n):
                    value, at = number(entry, at)
                    found.append(value)
                row[tag] = found
            rows.append(row)
    return rows, records[first + 1 + count : first + 1 + count + u32(head, 52)]


def contents(records: list[bytes], first: int, codec: str) -> list[tuple[str, int | None, int | None]]:
    """(title, byte offset, parent) of the entries; a useless one stays, for parents are numbers in this list."""
    rows, labels = index(records, first)
    out = []
    for k, row in enumerate(rows[:ENTRIES]):
        title = ""
        if LABEL in row and row[LABEL] and (at := row[LABEL][0]) >> 16 < len(labels):
            size, start = number(labels[at >> 16], at & 0xFFFF)
            title = " ".join(decode(labels[at >> 16][start : start + size], codec).split())
        parent = row[PARENT][0] if row.get(PARENT) else None
        out.append((title, row[OFFSET][0] if row.get(OFFSET) else None, parent if parent is not None and parent < k else None))
    return out


def trimmed(b: bytes, flags: int) -> bytes:
    """A text record without what the flags say is behind it."""
    for bit in range(15, 0, -1):
        if flags >> bit & 1 and b:
            size = 0
            for k, x in enumerate(reversed(b[-4:])):
                size |= (x & 0x7F) << 7 * k
                if x & 0x80:
                    break
            b = b[: max(0, len(b) - size)]
    return b[: max(0, len(b) - (b[-1] & 3) - 1)] if flags & 1 and b else b


def place(text: bytes, offset: int) -> int:
    """Where an anchor for an offset goes: there on a <, else behind the > before it."""
    at = min(max(offset, 0), len(text))
    if at == len(text) or text[at : at + 1] == b"<":
        return at
    near = text.rfind(b">", max(0, at - 512), at)
    return near + 1 if near >= 0 else at


def with_anchors(text: bytes, more: set[int] = frozenset()) -> bytes:
    """filepos links lead to anchors that are planted at their offsets, as at those of more."""
    offsets = {int(x) for x in re.findall(rb"filepos=[\"']?0*(\d+)", text)} | more
    out, last = [], 0
    for at, offset in sorted((place(text, x), x) for x in offsets):
        out += [text[last:at], b'<a id="fp%d"></a>' % offset]
        last = at
    text = b"".join([*out, text[last:]])
    return re.sub(rb"filepos=[\"']?0*(\d+)[\"']?", rb'href="#fp\1"', text)


def parse(content: bytes, path: str, sections: int | None = None, resources: bool = True) -> Book:
    b = content
    if len(b) < 86 or b[60:68] not in (b"BOOKMOBI", b"TEXtREAd"):
        raise ParseError("not a MOBI file")
    n = struct.unpack(">H", b[76:78])[0]
    starts = [struct.unpack(">I", b[78 + 8 * i : 82 + 8 * i])[0] for i in range(n)] + [len(b)]
    records = [b[a:z] for a, z in zip(starts, starts[1:], strict=False)]
    if not records or len(records[0]) < 16 or any(a > z for a, z in zip(starts, starts[1:], strict=False)):
        raise ParseError("damaged record list")
    head = records[0]
    packing, _, _, count, _, locked = struct.unpack(">HHIHHH", head[:14])
    if locked:
        raise ParseError("this book is encrypted")
    if packing not in (PLAIN, PALMDOC, HUFFMAN):
        raise ParseError("damaged header: unknown packing")

    def u32(at: int) -> int:
        return struct.unpack(">I", head[at : at + 4])[0] if at + 4 <= len(head) else 0

    mobi = head[16:20] == b"MOBI"
    size, codec = (u32(20), CODECS.get(u32(28), "utf-8")) if mobi else (0, "cp1252")
    flags = struct.unpack(">H", head[242:244])[0] if mobi and size >= 228 and len(head) >= 244 else 0
    book = Book("mobi", toc_is_fallback=True)
    if mobi:
        book.title = decode(head[u32(84) : u32(84) + u32(88)], codec)
    at, authors = 16 + size, []
    if mobi and u32(128) & 0x40 and head[at : at + 4] == b"EXTH":
        left, at = u32(at + 8), at + 12
        while left and at + 8 <= len(head):
            kind, n = u32(at), u32(at + 4)
            value = decode(head[at + 8 : at + max(n, 8)], codec).strip()
            if kind == AUTHOR:
                authors.append(value)
            elif kind == TITLE:
                book.title = value
            elif kind == LANGUAGE:
                book.language = value
            elif kind in (ISBN, ASIN):
                book.identifier = book.identifier or value
            left, at = left - 1, at + max(n, 8)
    book.author = ", ".join(x for x in authors if x)
    book.title = book.title or stem(path)

    parts, held, unpack = [], 0, {PLAIN: bytes, PALMDOC: unpacked}.get(packing)
    if unpack is None:
        first, n = u32(112), u32(116)
        if not first or not n or first + n > len(records):
            raise ParseError("damaged code tables")
        unpack = Huffman(records[first], records[first + 1 : first + n]).unpacked
    for r in records[1 : count + 1]:
        parts.append(unpack(trimmed(r, flags)))
        held += len(parts[-1])
        if held > LIMIT:
            break
    text = b"".join(parts)
    book.content_bytes = struct.unpack(">I", head[4:8])[0] or len(text)
    if len(text) > LIMIT:
        cut = text.rfind(b"<h", LIMIT - WINDOW, LIMIT)
        text, book.truncated_at = text[: cut if cut >= 0 else LIMIT], LIMIT
    entries = contents(records, u32(244), codec) if mobi and size >= 232 else []
    for title, offset, parent in entries:
        book.entry(parent, title, None, None if offset is None or offset > len(text) else f"fp{offset}")
    html = decode(with_anchors(text, {x for _, x, _ in entries if x is not None and x <= len(text)}), codec)
    html = re.sub(r"(?is)<head\b.*?</head\s*>|<\?xml[^>]*>|<!DOCTYPE[^>]*>|</?html[^>]*>|</?body[^>]*>|<mbp:pagebreak[^>]*>", "", html)
    html = re.sub(r'(?i)recindex=["\']?0*(\d+)["\']?', lambda m: f'src="mobi/{int(m[1]) - 1}"', html)
    book.sections.append((None, "", None, book.title, html))
    if resources and mobi and 0 < u32(108) < len(records):
        for i, r in enumerate(records[u32(108) :]):
            kind = next((mime for magic, mime in PICTURES.items() if r.startswith(magic)), None)
            if kind:
                book.resources.append((f"mobi/{i}", kind, r))
    return book
