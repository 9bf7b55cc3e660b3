"""Exact dedup: group by a 128-bit content hash, compare bytes within a group, keep one row of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_of


def content_hash(text: Column) -> Column:
    """128 bits (MD5) as binary."""
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. keep names the id that stays,
    "min" or "max". The first aggregate groups by (hash, text): the hash deals the rows, the text
    itself is compared, so rows that collide in the hash stay apart. Each map task first folds its
    own copies, so a text that a third of all rows share sends one row per task. Rows then find
    their group by hash and SHA-256, without their text; AQE splits a hot key in that join.

    An id that occurs in several rows with equal text is counted in each and kept in each. A null
    id never beats another; a group with null ids only keeps them. An empty table gives no row.
    Texts are read whole, however long. Other columns of docs are ignored.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).withColumn("_h", hash_of(F.col("_text")))
    groups = (
        rows.groupBy("_h", "_text")
        .agg(best("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_h", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    mine = rows.select("_id", "_h", F.sha2("_text", 256).alias("text_sha256"))
    return mine.join(groups, ["_h", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
