"""Markdown: front matter, and the common part of GFM as HTML."""

from __future__ import annotations

import re
from html import escape

from .common import decode, first_text, stem
from .model import Book


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """Keys of a leading --- block that --- or ... closes, and the rest; an open block is text."""
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return {}, text
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() in ("---", "...")), None)
    if end is None:
        return {}, text
    found = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        if colon:
            found[key.strip().lower()] = re.sub(r"""^(["'])(.*)\1$""", r"\2", value.strip())
    return found, "\n".join(lines[end + 1 :])


def slugs() -> callable:
    """A numbering of slugs: repeated ones get -1, -2 and so on."""
    seen = {}

    def slug(title: str) -> str:
        base = re.sub(r"\s+", "-", re.sub(r"[^\w\s-]", "", re.sub(r"<[^>]*>", "", title.lower())).strip())
        n = seen.get(base, 0)
        seen[base] = n + 1
        return f"{base}-{n}" if n else base

    return slug


ITEM = re.compile(r"^(\s*)([-*+]|\d{1,9}[.)])(?:\s+(.*))?$")
DEFINED = re.compile(r"^ {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?(?:\s+[\"'(].*)?\s*$")


def named(label: str) -> str:
    """What labels of links have to share."""
    return " ".join(label.lower().split())


def inline(text: str, links: dict[str, str] | None = None) -> str:
    """Code, math, escapes, links, pictures, strong, emphasis and strike-through; tags stay. links: addresses by label."""
    kept, links, text = [], links or {}, text.replace("\0", "\ufffd")

    def keep(s: str) -> str:
        kept.append(s)
        return f"\0{len(kept) - 1}\0"

    text = re.sub(r"(`+)(.+?)\1", lambda m: keep(f"<code>{escape(m[2].strip())}</code>"), text)
    text = re.sub(r"\$\$[^$]+\$\$|\$[^\s$](?:[^$\n]*[^\s$])?\$|\\\([^\n]+?\\\)", lambda m: keep(f'<span class="math">{escape(m[0])}</span>'), text)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(escape(m[1], quote=False)), text)
    text = re.sub(r"<((?:https?|mailto):[^\s<>]*)>", lambda m: keep(f'<a href="{escape(m[1])}">{escape(m[1].removeprefix("mailto:"))}</a>'), text)
    text = re.sub(r"</?[a-zA-Z][^<>]*>", lambda m: keep(m[0]), text)
    text = escape(text, quote=False)
    text = re.sub(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)", lambda m: keep(f'<img src="{escape(m[2])}" alt="{m[1]}">'), text)
    text = re.sub(r"\[([^\]]+)\]\(([^)\s]+)[^)]*\)", lambda m: f'{keep(f"""<a href="{escape(m[2])}">""")}{m[1]}</a>', text)
    if links:
        linked = lambda m: f'{keep(f"""<a href="{escape(links[named(m[2] or m[1])])}">""")}{m[1]}</a>' if named(m[2] or m[1]) in links else m[0]
        text = re.sub(r"\[([^\[\]]+)\](?:\[([^\[\]]*)\])?", linked, text)
    text = re.sub(r"(?<![\w\"'(>\0])(https?://|www\.)[^\s<>\0]*[^\s<>\0.,;:!?\"')*_~]", lambda m: keep(f'<a href="{"http://" if m[1] == "www." else ""}{m[0]}">{m[0]}</a>'), text)
    text = re.sub(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", r"<strong>\2</strong>", text)
    text = re.sub(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])", r"<em>\2</em>", text)
    text = re.sub(r"~~(?=\S)(.+?)(?<=\S)~~", r"<del>\1</del>", text)
    while "\0" in text:
        text = re.sub("\0(\\d+)\0", lambda m: kept[int(m[1])], text)
    return text


def items(lines: list[str], i: int) -> tuple[str, int | None, list[list[str]], int]:
    """Of the list that starts at line i its tag, first number, the lines of each item without their indent, and the line behind it."""
    first = ITEM.match(lines[i])
    indent, ordered = len(first[1]), first[2][0].isdigit()
    found, inner = [], 0
    while i < len(lines):
        line = lines[i]
        m, blank = ITEM.match(line), not line.strip()
        if m and len(m[1]) <= indent + 1 and m[2][0].isdigit() != ordered:
            break
        if m and len(m[1]) <= indent + 1:
            found.append([m[3] or ""])
            inner = len(line) - len(m[3] or "") if m[3] else len(m[0])
        elif blank:
            after = next((x for x in lines[i + 1 :] if x.strip()), "")
            n = ITEM.match(after)
            if not (n and n[2][0].isdigit() == ordered and len(n[1]) <= indent + 1 or len(after) - len(after.lstrip()) > indent):
                break
            found[-1].append("")
        else:
            found[-1].append(line[min(inner, len(line) - len(line.lstrip())) :])
        i += 1
    return ("ol" if ordered else "ul"), (int(first[2][:-1]) if ordered else None), found, i


def to_html(text: str, mdx: bool = False, links: dict[str, str] | None = None) -> str:
    """Headings, fences, quotes, lists within lists, tables, rules and paragraphs; raw HTML blocks stay."""
    out, slug, lines, i = [], slugs(), text.replace("\r\n", "\n").replace("\0", "\ufffd").split("\n"), 0
    if links is None:
        fenced, links = False, {}
        for k, line in enumerate(lines):
            fenced ^= bool(re.match(r"^\s*(```|~~~)", line))
            if not fenced and (m := DEFINED.match(line)):
                links.setdefault(named(m[1]), m[2])
                lines[k] = ""
    block = re.compile(r"^(#{1,6}\s|\s*(```|~~~)|>|\s*([-*+]|1[.)])\s|\s*$|<)")
    while i < len(lines):
        line = lines[i]
        if not line.strip() or mdx and re.match(r"(import|export)\b", line):
            i += 1
        elif m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out.append(f'<h{len(m[1])} id="{escape(slug(m[2]))}">{inline(m[2], links)}</h{len(m[1])}>')
            i += 1
        elif m := re.match(r"^\s*(```+|~~~+)\s*(\S*)", line):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m[1])), len(lines))
            code, name = "\n".join(lines[i + 1 : end]), m[2].lower()
            if name == "mermaid":
                out.append(f'<div class="mermaid">{escape(code)}</div>')
            elif name in ("math", "latex", "tex"):
                out.append(f'<div class="math">{escape(code)}</div>')
            else:
                out.append(f"<pre><code{f''' class="language-{escape(name)}"''' if name else ''}>{escape(code)}\n</code></pre>")
            i = end + 1
        elif line.startswith("    ") and not ITEM.match(line):
            end = next((j for j in range(i, len(lines)) if lines[j].strip() and not lines[j].startswith("    ")), len(lines))
            code = "\n".join(x[4:] for x in lines[i:end]).rstrip("\n")
            out.append(f"<pre><code>{escape(code)}\n</code></pre>")
            i = end
        elif re.match(r"^\s*([-*_])(\s*\1){2,}\s*$", line):
            out.append("<hr>")
            i += 1
        elif line.startswith(">"):
            end = next((j for j in range(i, len(lines)) if not lines[j].startswith(">")), len(lines))
            out.append("<blockquote>" + to_html("\n".join(re.sub(r"^>\s?", "", x) for x in lines[i:end]), False, links) + "</blockquote>")
            i = end
        elif ITEM.match(line) and ITEM.match(line)[3] is not None:
            name, number, found, i = items(lines, i)
            shown = []
            for item in found:
                cut = next((k for k, x in enumerate(item) if k and (not x.strip() or ITEM.match(x) or block.match(x))), len(item))
                head = re.sub(r"^\[([ xX])\]\s", lambda b: f'<input type="checkbox" disabled{"" if b[1] == " " else " checked"}> ', inline(" ".join(x.strip() for x in item[:cut]), links))
                rest = to_html("\n".join(item[cut:]), False, links)
                shown.append(f"<li>{head}{chr(10) + rest if rest else ''}</li>")
            start = f' start="{number}"' if number not in (None, 1) else ""
            out.append(f"<{name}{start}>" + "".join(shown) + f"</{name}>")
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            split = lambda x: [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", x.strip()))]
            sides = {(True, True): ' align="center"', (True, False): ' align="left"', (False, True): ' align="right"'}
            at = [sides.get((x.startswith(":"), x.endswith(":")), "") for x in split(lines[i + 1])]
            row = lambda x, tag: "<tr>" + "".join(f"<{tag}{a}>{inline(c, links)}</{tag}>" for c, a in zip([*split(x), *[""] * len(at)], at)) + "</tr>"  # noqa: B905, E731
            rows = row(line, "th")
            i += 2
            while i < len(lines) and lines[i].strip() and not block.match(lines[i]):
                rows += row(lines[i], "td")
                i += 1
            out.append(f"<table>{rows}</table>")
        elif line.startswith("<"):
            end = next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
            out.append("\n".join(lines[i:end]))
            i = end
        else:
            under = re.compile(r"^ {0,3}(=+|-+)\s*$")
            end = next((j for j in range(i + 1, len(lines)) if under.match(lines[j]) or block.match(lines[j])), len(lines))
            whole = [x.strip() for x in lines[i:end]]
            if end < len(lines) and (m := under.match(lines[end])):
                level = 1 if m[1][0] == "=" else 2
                title = " ".join(whole)
                out.append(f'<h{level} id="{escape(slug(title))}">{inline(title, links)}</h{level}>')
                end += 1
            else:
                for k, x in enumerate(lines[i : end - 1]):  # two spaces or a backslash break the line
                    whole[k] = whole[k].removesuffix("\\") + "<br>" if x.endswith(("  ", "\\")) else whole[k]
                out.append("<p>" + inline("\n".join(whole), links) + "</p>")
            i = end
    return "\n".join(out)


def parse(content: bytes, path: str, sections: int | None = None, resources: bool = True) -> Book:
    found, text = front_matter(decode(content, "utf-8").lstrip("﻿"))
    markup = to_html(text, mdx=path.lower().endswith(".mdx"))
    title = found.get("title") or first_text(markup, "h1") or stem(path)
    return Book("markdown", title=title, author=found.get("author"), sections=[(None, "", None, title, markup)], content_bytes=len(content))
