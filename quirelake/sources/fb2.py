"""FB2: one section of HTML, metadata, pictures, and the marks that guessed contents need."""

from __future__ import annotations

import base64
import binascii
import re
from html import escape
from xml.etree.ElementTree import Element

from .common import collapsed, decode, text_of, xml
from .model import Book, ParseError

#: Bytes of markup and of pictures; headings go to this level.
MARKUP, PICTURES, LEVEL = 8 << 20, 64 << 20, 3

# What FB2 elements become.
SIMPLE = {"emphasis": "em", "strong": "strong", "strikethrough": "del", "sub": "sub", "sup": "sup", "code": "code", "tr": "tr"}
CLASSED = {"subtitle": ("p", "fb2-subtitle"), "v": ("p", "fb2-verse"), "style": ("span", "fb2-style"), "stanza": ("div", "fb2-stanza"), "text-author": ("p", "fb2-text-author"), "section": ("div", "fb2-section")}
QUOTES = {"epigraph": ("blockquote", "fb2-epigraph"), "cite": ("blockquote", "fb2-cite"), "poem": ("div", "fb2-poem"), "annotation": ("div", "fb2-annotation")}


def text(content: bytes) -> str:
    """Decoded by the declared charset, then UTF-8, then windows-1251."""
    declared = re.search(rb"""<\?xml[^>]*encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""", content[:1024])
    return decode(content, declared and declared[1].decode("ascii"), "utf-8", "windows-1251")


def _id(x: Element) -> str:
    return f' id="{escape(x.get("id"))}"' if x.get("id") else ""


class Writer:
    """HTML of a body; stops after the top-level section that passes the limit."""

    def __init__(self, limit: int, one: bool):
        self.out, self.size, self.limit, self.one = [], 0, limit, one
        self.depth = self.quoting = self.titles = 0
        self.truncated = self.done = False

    def put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s.encode())

    def inside(self, x: Element, paragraph: bool) -> None:
        if x.text:
            self.put(escape(x.text))
        for child in x:
            if self.done:
                return
            self.element(child, paragraph)
            if child.tail and not self.done:
                self.put(escape(child.tail))

    def wrapped(self, open_tag: str, close_tag: str, x: Element, paragraph: bool) -> None:
        self.put(open_tag)
        self.inside(x, paragraph)
        self.put(close_tag)

    def element(self, x: Element, paragraph: bool = False) -> None:
        tag = x.tag
        if not isinstance(tag, str):
            return
        if tag == "section":
            self.depth += 1
            self.wrapped(f'<div class="fb2-section"{_id(x)}>', "</div>", x, False)
            self.depth -= 1
            if not self.depth and (self.one or self.size > self.limit):
                self.done, self.truncated = True, not self.one
        elif tag == "title":
            self.titles += 1
            level = min(max(self.depth, 1), LEVEL)
            a, b = ('<p class="fb2-minor-title">', "</p>") if self.quoting else (f"<h{level}>", f"</h{level}>")
            self.put(a)
            for i, p in enumerate(x):
                if p.tag == "p":
                    if any(q.tag == "p" for q in x[:i]):
                        self.put("<br>")
                    self.inside(p, True)
                else:
                    self.element(p, True)
            self.put(b)
        elif tag == "p":
            self.wrapped(f"<p{_id(x)}>", "</p>", x, True)
        elif tag in SIMPLE:
            self.wrapped(f"<{SIMPLE[tag]}>", f"</{SIMPLE[tag]}>", x, paragraph)
        elif tag in CLASSED:
            name, kind = CLASSED[tag]
            self.wrapped(f'<{name} class="{kind}"{_id(x)}>', f"</{name}>", x, tag in ("v", "style") or paragraph)
        elif tag in QUOTES:
            name, kind = QUOTES[tag]
            self.quoting += 1
            self.wrapped(f'<{name} class="{kind}"{_id(x)}>', f"</{name}>", x, False)
            self.quoting -= 1
        elif tag == "empty-line":
            self.put("<br>" if paragraph else '<div class="fb2-empty-line"></div>')
        elif tag == "a":
            kind = "fb2-note-ref" if x.get("type") == "note" else "fb2-link"
            self.wrapped(f'<a class="{kind}" href="{escape(x.get("href", ""))}">', "</a>", x, paragraph)
        elif tag == "image":
            if name := x.get("href", "").lstrip("#"):
                kind = "" if paragraph else ' class="fb2-image"'
                self.put(f'<img{kind} src="fb2/{escape(name)}" alt="{escape(x.get("alt", ""))}"{_id(x)}>')
        elif tag == "table":
            self.wrapped(f"<table{_id(x)}>", "</table>", x, paragraph)
        elif tag in ("td", "th"):
            span = "".join(f' {k}="{escape(x.get(k))}"' for k in ("colspan", "rowspan", "align") if x.get(k))
            self.wrapped(f"<td{span}>", "</td>", x, paragraph)
        else:
            self.inside(x, paragraph)


def parse(content: bytes, path: str, sections: int | None = None, resources: bool = True) -> Book:
    root = xml(text(content))
    if root.tag != "FictionBook":
        raise ParseError("not a FictionBook")
    book = Book("fb2")
    info = root.find("description/title-info")
    if info is not None:
        book.title = collapsed(text_of(info.find("book-title")))
        book.language = collapsed(text_of(info.find("lang")))
        names = [" ".join(t for x in a if x.tag in ("first-name", "middle-name", "last-name", "nickname") and (t := collapsed(text_of(x)))) for a in info.findall("author")]
        book.author = ", ".join(n for n in names if n)
        cover = info.find("coverpage/image")
        book.cover_path = cover.get("href", "").lstrip("#") if cover is not None else None
    book.identifier = collapsed(text_of(root.find("description/document-info/id")))
    writer = Writer(MARKUP, sections == 1)
    for i, b in enumerate(root.findall("body")):
        if i:
            writer.put('<div class="fb2-body-break"></div>')
        writer.inside(b, False)
        if writer.done:
            break
    markup = "".join(writer.out)
    book.sections.append((None, "", None, book.title or None, markup))
    book.content_bytes = writer.size
    book.truncated_at = writer.size if writer.truncated else None
    book.toc_is_fallback = writer.titles == 0
    used = 0
    for x in root.findall("binary") if resources else ():
        payload = (x.text or "").strip()
        if x.get("id") and payload and used < PICTURES:
            used += len(payload)
            try:
                book.resources.append((x.get("id"), x.get("content-type"), base64.b64decode(payload)))
            except (binascii.Error, ValueError):
                continue
    return book
