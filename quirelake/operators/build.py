"""A book from its sections: anchors, headings, links, contents, in this order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import links as L
from . import outline as O


@dataclass
class Built:
    sections: DataFrame  # book, section_idx, path, base, html with chapter-wise anchors
    headings: DataFrame  # book, section_idx, heading_idx, level, title, anchor, parent_idx
    links: DataFrame  # book, section_idx, link_idx, attr, raw, class, target
    contents: DataFrame  # book, entry_idx, parent_idx, title, href


def build(sections: DataFrame, declared: DataFrame, fallback: DataFrame) -> Built:
    """sections (book, section_idx, path, html), declared (book, entry_idx, parent_idx, title, section_path, fragment), fallback (book, is_fallback).

    Contents are the declared entries or the headings, as outline.choose() says; a book without
    declared entries counts as having none.
    """
    marked = sections.select("book", "section_idx", "path", T.parent(F.col("path")).alias("base"), T.prefixed(T.body(F.col("html")), F.col("section_idx")).alias("html"))
    heads = O.parents(O.headings(marked, ["book"], "section_idx", "html"), ["book"], "heading_idx", "level", 3)
    raw = L.links(marked, ["book", "section_idx", "base"], "html").withColumn("class", L.link_class(F.col("raw"), F.col("attr")))
    linked = L.resolved(raw, marked.select("book", "section_idx", "path"), ["book"]).drop("base")
    linked = linked.withColumn("target", F.when((F.col("attr") == "href") & F.col("class").isin("internal", "fragment"), F.col("target")))

    # one pass over all rows of a book counts both lists
    def tally(rows: DataFrame, n: int, k: int, is_fallback=F.lit(None).cast("boolean")) -> DataFrame:
        return rows.select("book", F.lit(n).alias("n"), F.lit(k).alias("k"), is_fallback.alias("f"))

    sizes = tally(marked, 0, 0).unionByName(tally(declared, 1, 0)).unionByName(tally(heads, 0, 1)).unionByName(tally(fallback, 0, 0, F.col("is_fallback")))
    sizes = sizes.groupBy("book").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.coalesce(F.max("f"), F.lit(False)).alias("f"))
    choice = sizes.select("book", O.choose(F.col("n"), F.col("k"), F.col("f")).alias("choice"))
    first = marked.where(F.col("path").isNotNull()).groupBy("book", F.col("path").alias("section_path")).agg(F.min("section_idx").alias("_to"))
    own = declared.join(choice.where("choice = 'declared'"), "book", "left_semi").join(first, ["book", "section_path"], "left")
    own = own.select("book", F.col("entry_idx").cast("long").alias("entry_idx"), F.col("parent_idx").cast("long").alias("parent_idx"), "title", T.contents_target(F.col("_to"), F.col("fragment"), F.col("section_path")).alias("href"))
    found = heads.join(choice.where("choice = 'derived'"), "book", "left_semi").select("book", F.col("heading_idx").alias("entry_idx"), F.col("parent_idx").cast("long").alias("parent_idx"), "title", F.concat(F.lit("#"), "anchor").alias("href"))
    return Built(marked, heads, linked, own.unionByName(found))
