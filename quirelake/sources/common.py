"""Decoding, paths and XML for parsers."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET
from urllib.parse import unquote

from .model import ParseError

_SPACE = re.compile(r"\s+")


def decode(data: bytes, *charsets: str | None) -> str:
    """The first charset that decodes, in the end Latin-1."""
    for name in charsets:
        try:
            if name:
                return data.decode(name)
        except (UnicodeDecodeError, LookupError):
            pass
    return data.decode("latin-1")


def unescaped(path: str) -> str:
    """Percent-decoded if that gives UTF-8 and no escape is broken."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", path):
        return path
    try:
        return unquote(path, errors="strict")
    except UnicodeDecodeError:
        return path


def normalize(path: str, base: str | None = None) -> str:
    """Root-relative spelling; base is the folder of the document the reference stands in."""
    value = re.split("[#?]", unescaped(path), maxsplit=1)[0]
    out = [] if value.startswith("/") else [x for x in (base or "").split("/") if x]
    for part in value.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def target(href: str | None, base: str) -> tuple[str | None, str | None]:
    """(section path, fragment) of a link in a table of contents."""
    if not href or href == "#":
        return None, None
    path, _, tail = href.partition("#")
    return (normalize(path, base) if path else None), (unescaped(tail) or None)


def parent(path: str) -> str:
    return path.rpartition("/")[0]


def extension(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[2].lower() if "." in name else ""


def stem(path: str) -> str:
    name = path.rpartition("/")[2]
    return name.rpartition(".")[0] or name


def body(source: str) -> tuple[str, str | None]:
    """Between the first <body ...> and the first </body>, and the id of the body."""
    low = source.lower()
    start, end = low.find("<body"), low.find("</body>")
    close = source.find(">", start) if start >= 0 else -1
    if start < 0 or end < 0 or close < 0 or close >= end:
        return source, None
    found = re.search(r"id\s*=\s*[\"']([^\"']+)[\"']", source[start : close + 1])
    return source[close + 1 : end], found and found[1]


def collapsed(markup: str) -> str:
    text = html.unescape(re.sub(r"<[^>]+>", " ", markup))
    return _SPACE.sub(" ", re.sub("[­​-‏﻿]", "", text)).strip()


def first_text(markup: str, *tags: str) -> str | None:
    for tag in tags:
        found = re.search(rf"<{tag}[^>]*>(.*?)</{tag}\s*>", markup, re.I | re.S)
        if found and (text := collapsed(found[1])):
            return text
    return None


def _entity(name: str) -> str:
    """A reference that XML knows: its own five as they are, names of HTML as numbers, others as text."""
    if name in ("amp", "lt", "gt", "quot", "apos"):
        return f"&{name};"
    value = html.entities.html5.get(name + ";")
    return "".join(f"&#{ord(c)};" for c in value) if value else f"&amp;{name};"


def xml(data: bytes | str) -> ET.Element:
    """Parsed XML whose names have lost their namespaces. Decoded text loses its encoding declaration."""
    if isinstance(data, str):
        data = re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", data).encode()
    data = re.sub(rb"&([A-Za-z][A-Za-z0-9]*);", lambda m: _entity(m[1].decode()).encode(), data)
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, ValueError, LookupError) as e:
        raise ParseError(f"malformed XML: {e}") from None
    for x in root.iter():
        if isinstance(x.tag, str):
            x.tag = x.tag.rpartition("}")[2]
            x.attrib = {k.rpartition("}")[2]: v for k, v in x.attrib.items()}
    return root


def text_of(element: ET.Element | None) -> str:
    return "".join(element.itertext()).strip() if element is not None else ""
