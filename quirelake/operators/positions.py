"""The ledger of reading positions: a fold of events, kept newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: rows that a prune keeps.
KEEP = 5000


def _last(value: str, when: Column) -> Column:
    return F.max_by(value, when)


def ledger(events: DataFrame) -> DataFrame:
    """One row per path from events (path, ts, seq, kind, title, author, size, anchor, section_offset, fraction, scroll_y).

    kind is "open" or "store". Opening counts and remembers the last title and author that are not
    empty and the last size, null or not; the first event sets first_read, which is 0 if that was a
    store. Storing sets the position and leaves the rest. ts is in epoch seconds; ties go by seq.
    """
    at = F.struct("ts", "seq")
    opened, stored = F.col("kind") == "open", F.col("kind") == "store"

    def when(cond: Column) -> Column:
        return F.when(cond, at)

    def kept(name: str) -> Column:
        return _last(name, when(opened & F.col(name).isNotNull() & (F.col(name) != "")))

    return events.groupBy("path").agg(
        kept("title").alias("title"),
        kept("author").alias("author"),
        _last("size", when(opened)).alias("size"),
        *[_last(c, when(stored)).alias(c) for c in ("anchor", "section_offset", "fraction", "scroll_y")],
        F.count_if(opened).alias("opens"),
        F.when(F.min_by("kind", at) == "open", F.min("ts")).otherwise(F.lit(0)).alias("first_read"),
        F.max(F.when(opened, F.col("ts"))).alias("last_read"),
        F.max("ts").alias("updated"),
    )


def lookup(positions: DataFrame, path: Column, size: Column) -> DataFrame:
    """The row of a path, unless both sizes are known and differ."""
    return positions.where((F.col("path") == path) & (F.col("size").isNull() | size.isNull() | (F.col("size") == size)))


def pruned(positions: DataFrame, order: list[Column], keep: int = KEEP) -> DataFrame:
    """The newest rows. One pass finds the last that stays, so the table itself is not sorted."""
    newest = positions.orderBy(*order).limit(keep)
    return positions.join(newest.select("path"), "path", "left_semi")


def history(positions: DataFrame, rows: int = 20) -> DataFrame:
    """The newest rows as people read them."""
    newest = positions.orderBy(F.desc("updated"), "path").limit(rows)
    return newest.select(F.right("path", F.lit(45)).alias("path"), F.to_date(F.timestamp_seconds("updated")).alias("day"), F.round("fraction", 3).alias("fraction"), "opens")


def nearest(value: Column, levels: list[float]) -> Column:
    """The level next to value; the smaller of two."""
    return F.array_min(F.array(*[F.struct(F.abs(value - F.lit(x)).alias("gap"), F.lit(x).alias("level")) for x in levels]))["level"]


def asof(points: DataFrame, marks: DataFrame, by: list[str], point: str, mark: str, values: list[str], tolerance: float = 0.0) -> DataFrame:
    """points with values of the last mark at or before point + tolerance; null before the first.

    Marks and points meet in one sorted window per group, without pairs. Of marks at the same
    place the last by values counts. points must not have columns named as values.
    """
    names = [c for c in points.columns if c not in by]
    empty = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in names]
    left = points.select(*by, (F.col(point) + F.lit(tolerance)).cast("double").alias("_at"), F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(marks.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_v"))
    right = marks.where(F.col(mark).isNotNull()).select(*by, F.col(mark).cast("double").alias("_at"), F.lit(0).alias("_side"), F.struct(*empty).alias("_row"), F.struct(*values).alias("_v"))
    order = Window.partitionBy(*by).orderBy("_at", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return met.select(*by, *[F.col("_row").getField(c).alias(c) for c in names], *[F.col("_v").getField(c).alias(c) for c in values])
