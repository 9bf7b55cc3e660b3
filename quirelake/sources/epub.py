"""EPUB: spine, metadata, and the contents of nav or NCX."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile

from .common import body, decode, extension, normalize, parent, target, text_of, xml
from .model import Book, ParseError

TEXT = ("xhtml", "html", "htm")


class Archive:
    """Entries of a zip, or of a folder as {path: bytes}, by path; a name is tried as it is and percent-encoded."""

    def __init__(self, content: bytes | dict[str, bytes]):
        self.files = content if isinstance(content, dict) else None
        self.by_path = {}
        if self.files is not None:
            self.names = list(self.files)
            self._index()
            return
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile:
            raise ParseError("not a zip archive") from None
        self.names = [x.filename for x in self.zip.infolist() if not x.is_dir()]
        self._index()

    def _index(self) -> None:
        for name in self.names:
            for key in (name, normalize("/" + name)):
                self.by_path.setdefault(key, name)

    def read(self, path: str) -> bytes | None:
        name = self.by_path.get(path)
        if self.files is not None:
            return self.files.get(name)
        try:
            return self.zip.read(name) if name else None
        except (zipfile.BadZipFile, RuntimeError, OSError, NotImplementedError):
            return None


def parse(content: bytes | dict[str, bytes], path: str, sections: int | None = None, resources: bool = True) -> Book:
    archive = Archive(content)
    opf_path = None
    if data := archive.read("META-INF/container.xml"):
        try:
            opf_path = next((normalize(x.get("full-path", "")) for x in xml(data).iter("rootfile")), None)
        except ParseError:
            pass
    opf_path = opf_path or next((x for x in sorted(archive.names) if extension(x) == "opf"), None)
    data = opf_path and archive.read(opf_path)
    if not data:
        raise ParseError("no package document")
    opf, base = xml(data), parent(opf_path)

    items = {x.get("id"): x for m in opf.iter("manifest") for x in m.iter("item") if x.get("id") and x.get("href")}
    spine = [items[x.get("idref")] for s in opf.iter("spine") for x in s.iter("itemref") if x.get("idref") in items]
    spine = [normalize(x.get("href"), base) for x in spine if extension(x.get("href")) in TEXT]
    if not spine:
        raise ParseError("no spine")

    book = Book("epub", toc_is_fallback=True, toc_base=base)
    for name in ("title", "creator", "language", "identifier"):
        value = next((t for m in opf.iter("metadata") for x in m.iter(name) if (t := text_of(x))), None)
        setattr(book, "author" if name == "creator" else name, value)
    book.cover_path = next((x.get("content") for x in opf.iter("meta") if x.get("name") == "cover"), None)

    for chapter in spine[:sections]:
        if (found := archive.read(chapter)) is not None:
            inner, body_id = body(decode(found, "utf-8"))
            book.sections.append((chapter, parent(chapter), body_id, None, inner))
    if not book.sections:
        raise ParseError("no section can be read")

    ncx = items.get(next((s.get("toc") for s in opf.iter("spine")), None))
    if ncx is None:
        ncx = next((x for x in items.values() if x.get("media-type") == "application/x-dtbncx+xml"), None)
    nav = next((x for x in items.values() if "nav" in x.get("properties", "").split()), None)
    for item, read in ((nav, _nav), (ncx, _ncx)):
        if item is not None and not book.toc:
            at = normalize(item.get("href"), base)
            try:
                if data := archive.read(at):
                    read(book, xml(data), parent(at))
            except ParseError:
                continue
            book.toc_base = parent(at) if book.toc else book.toc_base
    if resources:
        media = {normalize(x.get("href"), base): x.get("media-type") for x in items.values()}
        book.resources = [(p, media.get(p), archive.read(p)) for p in sorted(archive.by_path) if p == normalize("/" + p) and p not in spine and p != opf_path]
    return book


def _nav(book: Book, root: ET.Element, base: str) -> None:
    navs = list(root.iter("nav"))
    chosen = next((n for n in navs if "toc" in n.get("type", "").lower()), navs[0] if navs else None)
    top = next(chosen.iter("ol"), None) if chosen is not None else None

    def walk(ol: ET.Element, up: int | None) -> None:
        for li in ol.findall("li"):
            label = next((x for x in li if x.tag in ("a", "span")), None)
            below = li.find("ol")
            title = text_of(label)
            if title or below is not None and below.find("li") is not None:
                here = book.entry(up, title, *target(label.get("href") if label is not None else None, base))
                if below is not None:
                    walk(below, here)

    if top is not None:
        walk(top, None)


def _ncx(book: Book, root: ET.Element, base: str) -> None:
    def walk(point: ET.Element, up: int | None) -> None:
        title, content = text_of(point.find("navLabel/text")), point.find("content")
        below = point.findall("navPoint")
        if title or below:
            here = book.entry(up, title, *target(content.get("src") if content is not None else None, base))
            for x in below:
                walk(x, here)

    for nav_map in root.iter("navMap"):
        for point in nav_map.findall("navPoint"):
            walk(point, None)
