"""Helpers that the training-data operators have in common."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that Python gets, about; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or in local mode an own one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quirelake-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; release() removes what was written there."""
    _made.append(f"{shared_dir(spark)}/quirelake-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release(spark: SparkSession) -> None:
    """Removes all intermediate tables and files made so far, for use once results have been written."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there."""
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def trim() -> None:
    """Gives memory that a Python worker has freed back to the system, where that can be done."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that are over: it does so when their plans are collected as garbage."""
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that is none of columns."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, unless the session says how much."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def mapped(spark: SparkSession, run: Callable[[pa.Array], pa.Array], kind: str, column: Column) -> Column:
    """run over the Arrow batches of one column; the other columns of a row stay in the JVM."""
    small_batches(spark)

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(run, batches)

    return F.arrow_udf(each, kind)(column)


def mapped_pairs(spark: SparkSession, run: Callable[[pa.Array, pa.Array], pa.Array], kind: str, one: Column, two: Column) -> Column:
    """The same over two columns."""
    small_batches(spark)

    def each(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield run(a, b)

    return F.arrow_udf(each, kind)(one, two)


def beside(docs: DataFrame, keep: list[str], found: Column, results: dict[str, str]) -> DataFrame:
    """keep's columns and the fields of found, as results names them; a kept column of such a name gives way to it."""
    names = {x.lower() for x in results.values()}
    return docs.select(*[F.col(f"`{c}`") for c in keep if c.lower() not in names], *[found.getField(x).alias(y) for x, y in results.items()])


#: SHA-256 of nothing.
EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
