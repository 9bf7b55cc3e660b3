"""Links: extraction, classes, targets and joins with sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Schemes that lead out of a book, and attributes that hold a reference.
EXTERNAL = ("http:", "https:", "file:", "data:", "mailto:", "tel:", "javascript:", "blob:")
LINK = r'(?i)\b(?:src|href|poster)="[^"]+"'


def links(sections: DataFrame, keep: list[str], html: str) -> DataFrame:
    """Double-quoted src, href and poster of each section: link_idx, attr, raw."""
    found = F.regexp_extract_all(html, F.lit(LINK), F.lit(0))
    rows = sections.select(*keep, F.posexplode(found).alias("n", "m"))
    raw = F.replace(F.regexp_extract("m", r'(?s)="([^"]+)"', 1), F.lit("&amp;"), F.lit("&"))
    return rows.select(*keep, F.col("n").cast("long").alias("link_idx"), F.lower(F.regexp_extract("m", r"^(\w+)", 1)).alias("attr"), raw.alias("raw"))


def link_class(raw: Column, attr: Column, allow_remote: bool = False) -> Column:
    """fragment, remote, blocked (a remote picture), external or internal."""
    low = F.lower(raw)
    remote = low.startswith("http:") | low.startswith("https:") | raw.startswith("//")
    outside = low.startswith(EXTERNAL[0])
    for scheme in EXTERNAL[1:]:
        outside = outside | low.startswith(scheme)
    blocked = remote & (attr != "href") & F.lit(not allow_remote)
    return F.when(raw.startswith("#"), "fragment").when(blocked, "blocked").when(remote, "remote").when(outside, "external").otherwise("internal")


def host(raw: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(raw, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit("")), F.lit(""))


def blocked_label(raw: Column) -> Column:
    """What stands in for a remote picture."""
    at = host(raw)
    return F.when(at == "", "Network image blocked").otherwise(F.concat(F.lit("Network image blocked: "), at))


def inside(path: Column, root: Column) -> Column:
    """Whether a path stays below root."""
    return T.normalized(path, root).startswith(F.concat(T.normalized(root, F.lit("")), F.lit("/")))


def resolved(found: DataFrame, sections: DataFrame, book: list[str]) -> DataFrame:
    """links with target: #chN or #chN--fragment of the first section with the path, null where there is none.

    found has base and raw, sections section_idx and path.
    """
    first = sections.groupBy(*book, "path").agg(F.min("section_idx").alias("_to"))
    cut = found.withColumn("_path", T.normalized(F.regexp_extract("raw", r"(?s)^([^#]*)", 1), F.col("base")))
    on = [*(cut[b].eqNullSafe(first[b]) for b in book), cut["_path"] == first["path"]]
    joined = cut.join(first, on, "left")
    tail = F.coalesce(F.concat(F.lit("--"), T.fragment(cut["raw"])), F.lit(""))
    here = F.when(cut["raw"].startswith("#"), F.concat(F.lit("#"), T.fragment(cut["raw"])))
    return joined.select(*[cut[c] for c in found.columns], F.coalesce(here, F.concat(F.lit("#ch"), first["_to"].cast("string"), tail)).alias("target"))


def surviving(entries: DataFrame, anchors: DataFrame, book: list[str], target: str) -> DataFrame:
    """entries whose target is kept only where its anchor exists; no entry is dropped."""
    have = anchors.select(*[F.col(b).alias(f"_{b}") for b in book], F.col("anchor").alias("_anchor")).distinct()
    on = [*(F.col(b).eqNullSafe(F.col(f"_{b}")) for b in book), F.col(target) == F.col("_anchor")]
    return entries.join(have, on, "left").select(*[c for c in entries.columns if c != target], F.col("_anchor").alias(target))


def with_fallback(entries: DataFrame, anchors: DataFrame, book: list[str], href: str) -> DataFrame:
    """entries with anchor: the target itself, or its chapter where the anchor is missing."""
    have = anchors.select(*[F.col(b).alias(f"_{b}") for b in book], F.col("anchor").alias("_anchor")).distinct()
    bare = F.regexp_replace(F.col(href), "^#", "")
    on = [*(F.col(b).eqNullSafe(F.col(f"_{b}")) for b in book), bare == F.col("_anchor")]
    chapter = F.nullif(F.regexp_extract(href, r"^#(ch[0-9]+)", 1), F.lit(""))
    return entries.join(have, on, "left").select(*entries.columns, F.coalesce("_anchor", chapter).alias("anchor"))


def first_key_found(left: DataFrame, tables: list[tuple[DataFrame, str, Column, str]]) -> DataFrame:
    """left with `found`: the value of the first table whose key matches; each table is (frame, key, left's key, value).

    Of equal keys in a table the smallest value counts.
    """
    out, found = left, []
    for i, (frame, key, mine, value) in enumerate(tables):
        first = frame.groupBy(F.col(key).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(first, mine == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.select(*left.columns, F.coalesce(*found).alias("found"))
