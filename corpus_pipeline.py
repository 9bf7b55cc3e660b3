"""A corpus pipeline: language, repeated lines, near copies, benchmark passages, packing.

Every stage but the last returns the columns of documents. Ids are taken to be unique; of rows
with equal ids, near-dedup leaves one. Null texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.llm.decontaminate import marked
from quirelake.llm.langid import predicted, train
from quirelake.llm.line_dedup import line_dedup
from quirelake.llm.near_dedup import near_dedup
from quirelake.llm.packing import pack, vocabulary_path
from quirelake.llm.shared import fresh, staged, table


def columns_of(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


#: A language has to be likelier than all others together.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the rest goes."""
    found = predicted(train(docs), F.col("text"), spark)
    return docs.where((found.getField("lang") != "und") & (found.getField("score") >= LEAST_SCORE))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines go, and documents of which nothing else is left."""
    n, gone = fresh(docs.columns, "_n_lines"), fresh(docs.columns, "_n_removed")
    found = line_dedup(docs, counts=(n, gone)).where((F.col(gone) == 0) | (F.col(gone) < F.col(n))).select(*columns_of(docs))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: SimHash of 5-word shingles, then similarity 0.8 or more."""
    # keys as columns, so the window needs no shuffle of its own
    ids, null, n = (fresh(docs.columns, x) for x in ("_id", "_null", "_n"))
    key = [F.coalesce("doc_id", F.lit(0)).alias(ids), F.col("doc_id").isNull().alias(null)]
    stay = near_dedup(docs).select(F.col("component_id").alias("doc_id")).distinct().select(*key).hint("merge")
    found = docs.select("*", *key).join(stay, [ids, null], "left_semi")
    once = Window.partitionBy(ids, null).orderBy(F.xxhash64("text"))
    return found.withColumn(n, F.row_number().over(once)).where(F.col(n) == 1).select(*columns_of(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    name = fresh(docs.columns, "_found")
    return marked(docs, table(spark, sf_dir, "benchmark"), name).where(F.size(f"{name}.starts") == 0).select(*columns_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences."""
    return pack(docs, vocabulary_path())


STAGES = [("language ID", language), ("line dedup", lines), ("near dedup", near_copies), ("decontamination", benchmark), ("packing", packed)]

#: Language and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
