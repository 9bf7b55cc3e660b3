"""DjVu structure: chunks, pages and their sizes, annotations. Pictures and BZZ-packed chunks are not decoded."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .model import Book, ParseError


@dataclass
class Chunk:
    id: str
    kind: str | None
    at: int
    start: int
    end: int
    children: list[Chunk] = field(default_factory=list)

    def child(self, name: str) -> Chunk | None:
        return next((c for c in self.children if c.id == name), None)


def chunks(b: bytes, at: int, end: int) -> list[Chunk]:
    """IFF chunks between at and end; sizes are big-endian, odd ones are padded; a size beyond the end is cut."""
    out = []
    while at + 8 <= end:
        name, n = b[at : at + 4].decode("latin-1"), struct.unpack(">I", b[at + 4 : at + 8])[0]
        stop = min(at + 8 + n, end)
        if name == "FORM":
            out.append(Chunk(name, b[at + 8 : at + 12].decode("latin-1"), at, at + 8, stop, chunks(b, at + 12, stop)))
        else:
            out.append(Chunk(name, None, at, at + 8, stop))
        at = stop + n % 2
    return out


def info(b: bytes, form: Chunk) -> tuple[int, int, int]:
    """Width, height and dpi; 300 where dpi is missing or out of 25 to 6000."""
    chunk = form.child("INFO")
    if chunk is None or chunk.end - chunk.start < 4:
        return 0, 0, 0
    w, h = struct.unpack(">HH", b[chunk.start : chunk.start + 4])
    dpi = 300
    if chunk.end - chunk.start >= 8 and b[chunk.start + 6] != 0xFF:
        value = b[chunk.start + 7] << 8 | b[chunk.start + 6]
        dpi = value if 25 <= value <= 6000 else 300
    return w, h, dpi


def annotation(text: str, key: str) -> str | None:
    found = re.search(rf'\(\s*{re.escape(key)}\s*"((?:[^"\\]|\\.)*)"\s*\)', text, re.I)
    return found[1].replace('\\"', '"') or None if found else None


def fragment(url: str) -> str | None:
    """What follows the last # of an outline's link."""
    return url.rpartition("#")[2].strip() or None if "#" in url else None


def page_number(value: str, pages: list[tuple[str, str, str]]) -> int | None:
    """A page of (id, name, title) by 1-based number, then id or name, then title."""
    if re.fullmatch(r"\d+", value) and 1 <= int(value) <= len(pages):
        return int(value) - 1
    for fields in ((0, 1), (2,)):
        for i, p in enumerate(pages):
            if any(p[k] == value for k in fields):
                return i
    return None


def outline(flat: list[tuple[str, str, int]], book: Book) -> None:
    """Pre-order (title, url, number of children) as entries."""
    at = 0

    def walk(n: int, up: int | None) -> None:
        nonlocal at
        while n and at < len(flat):
            title, url, children = flat[at]
            at, n = at + 1, n - 1
            walk(children, book.entry(up, title, None, fragment(url)))

    walk(len(flat), None)


# Kinds of zones, from 1, and those that lie below the zone before them.
ZONES = ["page", "column", "region", "paragraph", "line", "word", "character"]
BELOW = {"page", "paragraph", "line"}


def zones(data: bytes) -> tuple[str, list[dict]]:
    """Hidden text of a plain text chunk and its zones in reading order, each with its parent's number, box and text.

    Places are written relative to the zone before, or else to the one around.
    """
    n = int.from_bytes(data[:3], "big")
    text, at = data[3 : 3 + n].decode("utf-8", "replace"), 3 + n
    rows: list[dict] = []
    if data[at : at + 1] != b"\1":
        return text, rows
    at += 1
    todo: list[list] = [[1, None, None]]  # zones to come, the one around them, the one before
    while todo:
        left, around, before = todo[-1]
        if not left:
            todo.pop()
            continue
        if at + 17 > len(data) or not 1 <= data[at] <= len(ZONES):
            raise ParseError("damaged text zones")
        kind = ZONES[data[at] - 1]
        x, y, w, h, start = (v - 0x8000 for v in struct.unpack(">5H", data[at + 1 : at + 11]))
        length, below = int.from_bytes(data[at + 11 : at + 14], "big"), int.from_bytes(data[at + 14 : at + 17], "big")
        at += 17
        if before is not None:
            p = rows[before]
            x, y = (x + p["xmin"], p["ymin"] - y - h) if kind in BELOW else (x + p["xmax"], y + p["ymin"])
            start += p["start"] + p["length"]
        elif around is not None:
            p = rows[around]
            x, y, start = x + p["xmin"], p["ymax"] - y - h, start + p["start"]
        rows.append({"zone_idx": len(rows), "parent_idx": around, "kind": kind, "xmin": x, "ymin": y, "xmax": x + w, "ymax": y + h, "start": start, "length": length, "text": text[max(start, 0) : max(start + length, 0)]})
        todo[-1] = [left - 1, around, len(rows) - 1]
        todo.append([below, len(rows) - 1, None])
    return text, rows


def page_zones(content: bytes) -> list[dict]:
    """Zones of all pages of a file that have plain hidden text."""
    top = chunks(content, 4, len(content)) if content[:4] == b"AT&T" else []
    if not top or top[0].id != "FORM":
        raise ParseError("not a DjVu file")
    pages = [top[0]] if top[0].kind == "DJVU" else [c for c in top[0].children if c.kind == "DJVU"]
    return [{"page_idx": i} | row for i, page in enumerate(pages) if (c := page.child("TXTa")) for row in zones(content[c.start : c.end])[1]]


def single_page(b: bytes, form: Chunk) -> bytes:
    """A page as a file of its own."""
    inner = b[form.at : form.end]
    return b"AT&T" + inner + (b"\0" if len(inner) % 2 else b"")


def parse(content: bytes, path: str, sections: int | None = None, resources: bool = True) -> Book:
    b = content
    top = chunks(b, 4, len(b)) if b[:4] == b"AT&T" else []
    form = top[0] if top and top[0].id == "FORM" else None
    if form is None or form.kind not in ("DJVU", "DJVM"):
        raise ParseError("not a DjVu file")
    if form.kind == "DJVU":
        components = [form]
    else:
        directory = form.child("DIRM")
        if directory is not None and directory.end > directory.start and not b[directory.start] & 0x80:
            raise ParseError("the pages of this DjVu lie in other files")
        components = [c for c in form.children if c.kind in ("DJVU", "DJVI", "THUM")]
    pages = [c for c in components if c.kind == "DJVU"]
    sizes = [info(b, c) for c in pages]
    if not pages or form.kind == "DJVU" and 0 in sizes[0][:2]:
        raise ParseError("no pages")
    book = Book("djvu", toc_is_fallback=True, toc_note="pages" if len(pages) > 1 else None)
    for i, (w, h, dpi) in enumerate(sizes):
        book.pages.append((str(i), str(i + 1), None, w, h, dpi))
        if len(pages) > 1:
            book.entry(None, str(i + 1), str(i))
    for owner in [*(c for c in components if c.kind == "DJVI"), *components, form]:
        chunk = owner.child("ANTa")
        if chunk is not None and "metadata" in (said := b[chunk.start : chunk.end].decode("utf-8", "replace")):
            book.title, book.author = annotation(said, "Title"), annotation(said, "Author")
            if book.title or book.author:
                break
    if resources:
        book.resources = [(str(i), "image/vnd.djvu", single_page(b, c)) for i, c in enumerate(pages)]
    return book
