"""Streams that keep tables: debounced changes and the ledger of positions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runs import debounced


def changes(events: DataFrame, by: list[str], ts: str, gap: str = "250 milliseconds", late: str = "1 second") -> DataFrame:
    """Bursts of a stream of file changes; each is sent once, when the watermark has passed its end."""
    return debounced(events.withWatermark(ts, late), by, ts, gap)


# One row per path; opens add up, other columns come from the newer side.
FIRST = ("first_read",)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two ledgers as one: `new` folds events that come after those of `old`."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, "path", "full")
    opened = F.coalesce(F.col("b.opens"), F.lit(0)) > 0
    stored = F.col("b.anchor").isNotNull() | F.col("b.scroll_y").isNotNull() | F.col("b.fraction").isNotNull()
    position = [F.when(stored, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("anchor", "section_offset", "fraction", "scroll_y")]
    return both.select(
        "path",
        F.coalesce("b.title", "a.title").alias("title"),
        F.coalesce("b.author", "a.author").alias("author"),
        F.when(opened, F.col("b.size")).otherwise(F.col("a.size")).alias("size"),
        *position,
        (F.coalesce(F.col("a.opens"), F.lit(0)) + F.coalesce(F.col("b.opens"), F.lit(0))).alias("opens"),
        F.coalesce("a.first_read", "b.first_read").alias("first_read"),
        F.coalesce("b.last_read", "a.last_read").alias("last_read"),
        F.greatest(F.col("a.updated"), F.col("b.updated")).alias("updated"),
    )


class Snapshots:
    """A ledger as snapshots of Parquet files in a shared folder, for foreachBatch.

    Parquet has no MERGE: each batch writes a new snapshot, named by batch, and a pointer table that
    names the newest. A batch that runs again starts from the snapshot before it, so it counts once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log: list[tuple[int, str]] = []

    def read(self, before: int | None = None) -> DataFrame | None:
        paths = [p for b, p in self.log if before is None or b < before]
        return self.spark.read.parquet(paths[-1]) if paths else None

    def __call__(self, batch: DataFrame, number: int) -> None:
        from ..operators.positions import ledger

        new, old = ledger(batch), self.read(number)
        path = f"{self.folder}/snapshot-{number}-{uuid.uuid4().hex}"
        (merged(old, new) if old is not None else new).write.parquet(path)
        self.log = [x for x in self.log if x[0] < number] + [(number, path)]
