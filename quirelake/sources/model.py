"""What a parser gives for a file, and its Spark schema. Trees are adjacency lists: parent_idx points to an earlier row."""

from __future__ import annotations

from dataclasses import dataclass, field

SCHEMA = """
path string, format string, parse_error string,
title string, author string, language string, identifier string, cover_path string,
toc_is_fallback boolean, toc_base string, toc_note string, truncated_at long, content_bytes long,
sections array<struct<section_idx: int, source_path: string, base_path: string, body_id: string, title: string, html: string>>,
toc array<struct<entry_idx: int, parent_idx: int, depth: int, title: string, section_path: string, fragment: string>>,
resources array<struct<path: string, mime: string, content: binary>>,
pages array<struct<page_idx: int, path: string, label: string, folder: string, width: int, height: int, dpi: int>>,
bookmarks array<struct<page_idx: int, title: string>>
"""


class ParseError(Exception):
    """A file that cannot be read as what its name says; the message is data."""


@dataclass
class Book:
    format: str
    title: str | None = None
    author: str | None = None
    language: str | None = None
    identifier: str | None = None
    cover_path: str | None = None
    toc_is_fallback: bool = False
    toc_base: str | None = None
    toc_note: str | None = None
    truncated_at: int | None = None
    content_bytes: int | None = None
    sections: list[tuple] = field(default_factory=list)  # source_path, base_path, body_id, title, html
    toc: list[tuple] = field(default_factory=list)  # parent_idx, depth, title, section_path, fragment
    resources: list[tuple] = field(default_factory=list)  # path, mime, content
    pages: list[tuple] = field(default_factory=list)  # path, label, folder, width, height, dpi
    bookmarks: list[tuple] = field(default_factory=list)  # page_idx, title

    def entry(self, parent: int | None, title: str, section_path: str | None = None, fragment: str | None = None) -> int:
        depth = self.toc[parent][1] + 1 if parent is not None else 0
        self.toc.append((parent, depth, title, section_path, fragment))
        return len(self.toc) - 1

    def row(self, path: str) -> dict:
        named = lambda names, rows: [dict(zip(names.split(), r, strict=True)) for r in rows]
        blank = lambda x: x.strip() or None if isinstance(x, str) else x
        return {
            "path": path, "format": self.format, "parse_error": None,
            "title": blank(self.title), "author": blank(self.author), "language": blank(self.language), "identifier": blank(self.identifier), "cover_path": blank(self.cover_path),
            "toc_is_fallback": self.toc_is_fallback, "toc_base": self.toc_base, "toc_note": self.toc_note, "truncated_at": self.truncated_at, "content_bytes": self.content_bytes,
            "sections": [{"section_idx": i} | x for i, x in enumerate(named("source_path base_path body_id title html", self.sections))],
            "toc": [{"entry_idx": i} | x for i, x in enumerate(named("parent_idx depth title section_path fragment", self.toc))],
            "resources": named("path mime content", self.resources),
            "pages": [{"page_idx": i} | x for i, x in enumerate(named("path label folder width height dpi", self.pages))],
            "bookmarks": named("page_idx title", self.bookmarks),
        }
