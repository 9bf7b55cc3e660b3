"""Comic archives, zip or tar by their bytes: pages in reading order, sizes, ComicInfo."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile

from .common import decode, extension, stem, xml
from .images import size
from .model import Book, ParseError

# Extensions of pages.
PICTURES = {"jpg", "jpeg", "jpe", "png", "gif", "webp", "bmp", "tif", "tiff", "avif", "heic"}
#: Bytes that are read first for a picture's header, and then if those tell nothing.
HEAD, MORE = 64 << 10, 4 << 20


def kind(content: bytes) -> str:
    """zip, rar or tar, by magic numbers or a tar header's checksum."""
    if content[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if content[:4] == b"Rar!":
        return "rar"
    head = content[:512]
    if head[257:262] == b"ustar":
        return "tar"
    try:
        total = int(head[148:156].split(b"\0")[0].strip() or b"0", 8)
    except ValueError:
        return "unknown"
    return "tar" if len(head) == 512 and total and total == sum(head[:148]) + 8 * 32 + sum(head[156:]) else "unknown"


def is_noise(path: str) -> bool:
    name = path.rpartition("/")[2]
    return path.startswith(("__MACOSX/", ".")) or name.startswith(("._", "Thumbs.db")) or name == ".DS_Store"


def natural_key(name: str) -> tuple[str, int, str]:
    """Runs of digits as numbers, letters without regard to case; then shorter names, then the name."""
    return re.sub(r"[0-9]+", lambda m: f"{len(n := m[0].lstrip('0') or '0'):010d}{n}", name.lower()), len(name), name


def _entries(content: bytes) -> tuple[list[str], object]:
    what = kind(content)
    if what == "rar":
        raise ParseError("rar archives are not read")
    try:
        if what == "zip":
            archive = zipfile.ZipFile(io.BytesIO(content))

            def read(path: str, most: int | None = None) -> bytes:
                with archive.open(path) as f:
                    return f.read(most) if most else f.read()

            return [x.filename for x in archive.infolist() if not x.is_dir()], read
        if what == "tar":
            tar = tarfile.open(fileobj=io.BytesIO(content))
            members = {x.name: x for x in tar.getmembers() if x.isfile()}
            return list(members), lambda path, most=None: tar.extractfile(members[path]).read(most or -1)
    except (zipfile.BadZipFile, tarfile.TarError):
        pass
    raise ParseError("not a comic archive")


def comic_info(data: bytes) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Fields and (page reference, title) bookmarks; names without regard to case."""
    root = xml(decode(data, "utf-8"))
    fields, marks = {}, []
    for x in root.iter():
        tag = x.tag.lower() if isinstance(x.tag, str) else ""
        if tag in ("series", "number", "title", "writer") and (x.text or "").strip():
            fields[tag] = x.text.strip()
        if tag == "page":
            a = {k.lower(): v for k, v in x.attrib.items()}
            title, reference = a.get("bookmark", "").strip(), a.get("image", a.get("imagename"))
            if title and reference is not None:
                marks.append((reference, title))
    return fields, marks


def page_of(reference: str, paths: list[str]) -> int | None:
    """A page by its number, else by file name."""
    value = reference.strip()
    if re.fullmatch(r"[+-]?\d+", value):
        return int(value) if 0 <= int(value) < len(paths) else None
    name = value.rpartition("/")[2].lower()
    return next((i for i, p in enumerate(paths) if p.rpartition("/")[2].lower() == name), None)


def parse(content: bytes, path: str, sections: int | None = None, resources: bool = True) -> Book:
    names, read = _entries(content)
    names = [x for x in names if not is_noise(x)]
    info = [x for x in names if x.rpartition("/")[2].lower() == "comicinfo.xml"]
    pages = sorted((x for x in names if extension(x) in PICTURES), key=natural_key)
    if not pages:
        raise ParseError("no pages")
    book = Book("cbz", toc_is_fallback=True)
    for p in pages:
        w, h = (0, 0)
        if sections is None:
            w, h = size(read(p, HEAD))
            w, h = (w, h) if w and h else size(read(p, MORE))
        book.pages.append((p, stem(p), p.rpartition("/")[0] or None, w, h, None))
    fields, marks = {}, []
    if info:
        try:
            fields, marks = comic_info(read(info[-1]))
        except ParseError:
            pass
    series, number = fields.get("series"), fields.get("number")
    book.title = (f"{series} #{number}" if number else series) if series else fields.get("title")
    book.author = fields.get("writer")
    book.bookmarks = [(i, title) for reference, title in marks if (i := page_of(reference, pages)) is not None]
    if book.bookmarks:
        for i, title in book.bookmarks:
            book.entry(None, title, pages[i])
        book.toc_is_fallback = False
    elif len(pages) > 1:
        folder, up = None, None
        for p, label, here, *_ in book.pages:
            if here != folder:
                folder, up = here, book.entry(None, here) if here else None
            book.entry(up, label, p)
        book.toc_note = "pages"
    if resources:
        book.resources = [(p, f"image/{'jpeg' if extension(p) in ('jpg', 'jpe') else extension(p)}", read(p)) for p in pages]
    return book
