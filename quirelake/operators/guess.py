"""Guessed contents: paragraphs that look like headings, in three tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def promoted(paragraphs: DataFrame, book: list[str]) -> DataFrame:
    """Headings of each book from paragraphs (book, idx, label, section, depth, section_first, section_size, bold).

    label is lower-cased text. Tier 1 takes the first paragraph of a section of three or more, at the
    section's depth (1 to 3). Tier 2 takes labels that name a level. Tier 3 takes paragraphs that are
    one bold run, and only in books with fewer than three of tier 2. Tiers 2 and 3 leave out sections
    that are a table of contents, unless tier 1 found fewer than three. Of equal labels the first by
    tier and place counts.
    """
    first = F.col("idx") == F.col("section_first")
    label = F.col("label")
    one = first & (F.col("section_size") >= 3) & T.heading_like(label, 140)
    level = T.guessed_level(label)
    contents = F.max(first & label.isin(*T.CONTENTS)).over(Window.partitionBy(*book, "section"))
    # one shuffle by book serves every window below
    rows = paragraphs.where(label != "").repartition(*book).withColumn("_contents", F.coalesce(contents, F.lit(False)) & F.col("section").isNotNull())
    rows = rows.withColumn("_one", F.coalesce(one, F.lit(False))).withColumn("_level", level)
    whole = Window.partitionBy(*book)
    rank = Window.partitionBy(*book, "label")

    def is_first(cond: Column) -> Column:
        """First of its label among the rows of cond."""
        return cond & (F.min(F.when(cond, F.col("idx"))).over(rank) == F.col("idx"))

    rows = rows.withColumn("_t1", is_first(F.col("_one"))).withColumn("_titled", F.max("_one").over(rank))
    rows = rows.withColumn("_n1", F.count_if("_t1").over(whole))
    spare = ~(F.col("_contents") & (F.col("_n1") >= 3))
    rows = rows.withColumn("_two", spare & F.col("_level").isNotNull() & ~F.col("_titled"))
    rows = rows.withColumn("_t2", is_first(F.col("_two"))).withColumn("_named", F.max("_two").over(rank)).withColumn("_n2", F.count_if("_t2").over(whole))
    rows = rows.withColumn("_three", spare & F.col("bold") & ~F.col("_titled") & ~F.col("_named") & (F.col("_n2") < 3))
    rows = rows.withColumn("_t3", is_first(F.col("_three")))
    depth = F.least(F.greatest(F.col("depth"), F.lit(1)), F.lit(3))
    tier = F.when(F.col("_t1"), 1).when(F.col("_t2"), 2).when(F.col("_t3"), 3)
    picked = rows.withColumn("tier", tier).where("tier IS NOT NULL")
    return picked.select(*book, "idx", "label", "tier", F.when(F.col("tier") == 1, depth).when(F.col("tier") == 2, F.col("_level")).otherwise(F.lit(2)).cast("int").alias("level"))
