"""Headings and tables of contents as adjacency lists."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Headings kept of a book, and what a heading is.
LIMIT = 800
HEADING = r"(?is)<h([1-3])([^>]{0,400})>(.{0,600}?)</h\1\s*>"


def headings(sections: DataFrame, book: list[str], section: str | None, html: str, limit: int = LIMIT) -> DataFrame:
    """Headings h1 to h3 of each book in reading order: heading_idx, level, title, anchor.

    Headings without text do not count. A heading without id gets one from its section and number.
    A book of one section needs no shuffle; others are numbered across their sections.
    """
    chapter = F.col(section).cast("long") if section else F.lit(0).cast("long")
    found = F.transform(F.regexp_extract_all(html, F.lit(HEADING), F.lit(0)), lambda m: F.struct(
        F.substr(m, F.lit(3), F.lit(1)).cast("int").alias("level"),
        T.collapsed(m).alias("title"),
        F.regexp_extract(F.regexp_extract(m, r"(?is)^<h[1-3]([^>]{0,400})>", 1), r"(?i)\bid\s*=\s*[\"']([^\"'<>]{1,200})[\"']", 1).alias("id"),
    ))
    found = F.filter(found, lambda x: x["title"] != "")
    if section is None:
        found = F.slice(found, 1, limit)
    rows = sections.select(*book, chapter.alias("section_idx"), F.posexplode(found).alias("n", "h"))
    if section is not None:
        order = Window.partitionBy(*book).orderBy("section_idx", "n")
        rows = rows.withColumn("n", F.row_number().over(order) - 1).where(F.col("n") < limit)
    mint = F.concat(F.lit("ch"), F.col("section_idx").cast("string"), F.lit("--h"), F.col("n").cast("string"))
    return rows.select(*book, "section_idx", F.col("n").cast("long").alias("heading_idx"), "h.level", "h.title", F.coalesce(F.nullif("h.id", F.lit("")), mint).alias("anchor"))


def parents(entries: DataFrame, book: list[str], idx: str, level: str, levels: int = 6) -> DataFrame:
    """entries with parent_idx: the nearest entry before with a smaller level; null at the top."""
    before = Window.partitionBy(*book).orderBy(idx).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(idx))).over(before) for k in range(1, levels)]
    smaller = [F.when(F.col(level) > k, last[k - 1]) for k in range(1, levels)]
    return entries.withColumn("parent_idx", F.greatest(*smaller) if len(smaller) > 1 else smaller[0])


def folds(entries: DataFrame, book: list[str], idx: str, level: str, levels: int = 6) -> DataFrame:
    """entries with fold_end: the next entry of the same or a smaller level; null at the end."""
    after = Window.partitionBy(*book).orderBy(idx).rowsBetween(1, Window.unboundedFollowing)
    upto = [F.when(F.col(level) >= k, F.min(F.when(F.col(level) == k, F.col(idx))).over(after)) for k in range(1, levels + 1)]
    return entries.withColumn("fold_end", F.least(*upto))


def extents(entries: DataFrame, book: list[str], offset: str, bottom: Column) -> DataFrame:
    """entries with extent_end: where the next one starts, or bottom."""
    return entries.withColumn("extent_end", F.coalesce(F.lead(offset).over(Window.partitionBy(*book).orderBy(offset)), bottom))


def choose(declared: Column, derived: Column, fallback: Column) -> Column:
    """Which table of contents a book gets: derived where none is declared, or where the declared one is a fallback and smaller."""
    return F.when(declared == 0, "derived").when(fallback & (derived > declared), "derived").otherwise("declared")


def page_contents(declared: Column, pages: Column) -> Column:
    """Contents of a book of page images: declared, none for a single page, else its list of pages."""
    return F.when(declared > 0, "declared").when(pages <= 1, "none").otherwise("pages")


def numbered(entries: DataFrame, book: list[str], name: str, order: list[str]) -> DataFrame:
    """entries with slug: repeated names of a book get -1, -2 and so on."""
    n = F.row_number().over(Window.partitionBy(*book, name).orderBy(*order)) - 1
    return entries.withColumn("slug", F.when(n == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), n.cast("string"))))


def spliced(nodes: DataFrame, book: list[str]) -> DataFrame:
    """Tree of parent pointers without its untitled nodes: their children go to the next titled node above, however far.

    A parent has to come before its child; other pointers make a root. The outline of a book is
    folded in one task, in one pass, since a parent's place is known before its children come.
    """
    tree = nodes.select(*book, F.col("idx").cast("long"), "title", F.when(F.col("parent_idx") < F.col("idx"), F.col("parent_idx")).cast("long").alias("parent_idx"))

    def fold(data: pa.Table) -> pa.Table:
        data = data.sort_by("idx")
        place, kept, up = {}, [], []  # of each node so far, the titled one that its children hang on
        for i, (idx, title, parent) in enumerate(zip(*(data.column(c).to_pylist() for c in ("idx", "title", "parent_idx")), strict=True)):
            at = place.get(parent)
            if title is not None and title != "":
                kept.append(i), up.append(at)
                at = idx
            place[idx] = at
        data = data.take(pa.array(kept, pa.int64()))
        return data.set_column(data.schema.names.index("parent_idx"), "parent_idx", pa.array(up, pa.int64()))

    return tree.groupBy(*book).applyInArrow(fold, tree.schema).select(*book, "idx", "title", "parent_idx")
