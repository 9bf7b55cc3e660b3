"""Compiled help files: directory, system records, topics in order and contents by folder."""

from __future__ import annotations

import re
import struct

from .common import body, decode, extension, first_text, parent, stem
from .lzx import FRAME, Decoder
from .model import Book, ParseError

#: Bytes of markup that are kept.
MARKUP = 8 << 20
NOTE = "This file has no table of contents; the list is made of the titles of its pages."
# Charset labels and codecs.
CHARSETS = {x: "gb18030" for x in ("gb2312", "gbk", "gb18030", "cp936", "x-gbk")} | {"cp950": "big5", "sjis": "shift_jis", "shift-jis": "shift_jis", "x-sjis": "shift_jis", "cp949": "euc_kr", "cp1251": "windows-1251"}


class Container:
    def __init__(self, b: bytes):
        if b[:4] != b"ITSF" or len(b) <= 0x60:
            raise ParseError("not a CHM file")
        self.b = b
        version, at, size = self.u32(4), self.u64(0x48), self.u64(0x50)
        if version not in (2, 3) or b[at : at + 4] != b"ITSP":
            raise ParseError("no CHM directory")
        self.data = self.u64(0x58) if version == 3 else at + size
        head, block, first, last = (self.u32(at + x) for x in (8, 0x10, 0x20, 0x24))
        if not block or last < first or last > len(b) // block:
            raise ParseError("bad CHM directory")
        self.entries = []
        for chunk in range(first, last + 1):
            start = at + head + chunk * block
            if b[start : start + 4] == b"PMGL":
                self._chunk(start + 0x14, min(len(b), start + block - self.u32(start + 4)))
        self.by_path = {}
        for e in self.entries:
            self.by_path.setdefault(self.canonical(e[0]), e)
        self.runs = {}

    @staticmethod
    def canonical(path: str) -> str:
        return path if path.startswith(("/", "::")) else "/" + path

    def u32(self, at: int) -> int:
        return int.from_bytes(self.b[at : at + 4], "little")

    def u64(self, at: int) -> int:
        return int.from_bytes(self.b[at : at + 8], "little")

    def _chunk(self, at: int, end: int) -> None:
        def number() -> int:
            nonlocal at
            value = 0
            while at < end:
                byte = self.b[at]
                at += 1
                value = value << 7 | byte & 0x7F
                if byte < 0x80:
                    return value
            raise ParseError("CHM directory ends early")

        while at < end:
            n = number()
            if not n or at + n > len(self.b):
                break
            name = self.b[at : at + n].decode("utf-8", "replace")
            at += n
            self.entries.append((name, number(), number(), number()))

    def read(self, entry: tuple[str, int, int, int] | None) -> bytes:
        if entry is None:
            raise ParseError("no such file in the CHM")
        _, space, start, size = entry
        if not space:
            if self.data + start + size > len(self.b):
                raise ParseError("CHM file ends early")
            return self.b[self.data + start : self.data + start + size]
        self._open()
        if start + size > self.total:
            raise ParseError("CHM file ends early")
        first = start // FRAME
        out = b"".join(self._frame(i) for i in range(first, (start + size - 1) // FRAME + 1)) if size else b""
        return out[start - first * FRAME :][:size]

    def _open(self) -> None:
        """Sizes, reset table and content of the compressed section."""
        if hasattr(self, "content"):
            return
        control = self.read(self.by_path.get("::DataSpace/Storage/MSCompressed/ControlData"))
        if control[4:8] != b"LZXC":
            raise ParseError("unknown CHM compression")
        version, interval, window = struct.unpack("<III", control[8:20])
        unit = FRAME if version >= 2 else 1
        self.bits, self.interval = (window * unit).bit_length() - 1, max(1, interval * unit // FRAME)
        if not 15 <= self.bits <= 21 or 1 << self.bits != window * unit:
            raise ParseError("bad LZX window")
        table = next((e for e in reversed(self.entries) if e[0].endswith("/InstanceData/ResetTable")), None)
        reset = self.read(table)
        count, width = struct.unpack("<II", reset[4:12])
        self.total = int.from_bytes(reset[0x10:0x18], "little")
        self.starts = [int.from_bytes(reset[0x28 + i * max(width, 8) :][:width], "little") for i in range(count)]
        self.content = self.read(self.by_path.get("::DataSpace/Storage/MSCompressed/Content"))

    def _frame(self, i: int) -> bytes:
        """Frames between two resets are decoded in order; the last such run is kept."""
        first = i - i % self.interval
        if first not in self.runs:
            self.runs = {first: (Decoder(self.bits), [])}
        decoder, frames = self.runs[first]
        while len(frames) <= i - first:
            k = first + len(frames)
            if k >= len(self.starts):
                raise ParseError("CHM reset table is short")
            end = self.starts[k + 1] if k + 1 < len(self.starts) else len(self.content)
            frames.append(decoder.frame(self.content[self.starts[k] : end], min(FRAME, self.total - k * FRAME)))
        return frames[i - first]


def system(c: Container) -> dict[int, str]:
    """Records of /#SYSTEM by code: 2 default topic, 3 title, 5 contents file, 6 index file, 9 compiler."""
    out, at = {}, 4
    try:
        raw = c.read(c.by_path.get("/#SYSTEM"))
    except ParseError:
        return out
    while at + 4 <= len(raw):
        code, n = struct.unpack("<HH", raw[at : at + 4])
        if at + 4 + n > len(raw):
            break
        if code in (2, 3, 5, 6, 9):
            out[code] = raw[at + 4 : at + 4 + n].strip(b"\0").decode("utf-8", "replace")
        at += 4 + n
    return out


def text(content: bytes) -> str:
    found = re.search(rb"charset=[\"']?([^\"'> ;]+)", content[:2048], re.I)
    name = found[1].decode("ascii", "replace").lower() if found else None
    return decode(content, CHARSETS.get(name, name), "utf-8")


def parse(content: bytes, path: str, sections: int | None = None, resources: bool = True) -> Book:
    c = Container(content)
    info = system(c)
    topics = [e for e in c.entries if extension(e[0]) in ("htm", "html") and not e[0].startswith(("/#", "/$", "/::"))]
    default = c.canonical(info[2]) if info.get(2) else None
    topics.sort(key=lambda e: c.canonical(e[0]) != default)
    book, markup, titles, kept = Book("chm", title=info.get(3) or stem(path), content_bytes=0), 0, {}, set()
    for e in topics[:sections]:
        try:
            source = text(c.read(e))
        except ParseError:
            continue
        book.content_bytes += len(source.encode())
        inner, body_id = body(source)
        at = e[0].lstrip("/")
        titles[at] = first_text(source, "title", "h1") or at.rpartition("/")[2]
        markup += len(inner.encode())
        if markup > MARKUP:
            book.truncated_at = markup
            break
        kept.add(at)
        book.sections.append((at, parent(at), body_id, titles[at], inner))
    if not book.sections:
        raise ParseError("no topic can be read")
    folders: dict[str, list[str]] = {}
    for e in topics:
        at = e[0].lstrip("/")
        folders.setdefault(parent(at), []).append(at)
    if len(folders.get("", [])) + len(folders) - ("" in folders) > 1:
        book.toc_note = NOTE
        for folder in sorted(folders):
            up = book.entry(None, folder) if folder else None
            for at in folders[folder]:
                book.entry(up, titles.get(at, at.rpartition("/")[2]), at if at in kept else None)
    if resources:
        for e in c.entries:
            if e not in topics and e[0].startswith("/") and not e[0].endswith("/") and not e[0].startswith(("/#", "/$")):
                try:
                    book.resources.append((e[0].lstrip("/"), None, c.read(e)))
                except ParseError:
                    continue
    return book
