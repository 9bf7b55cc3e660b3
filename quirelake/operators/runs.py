"""Runs, budgets and first occurrences over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """rows with run: numbers the stretches of equal value, from 0."""
    at = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(at).eqNullSafe(F.col(value)) & (F.row_number().over(at) > 1), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn("run", (F.sum("_new").over(at.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("long")).drop("_new")


def within_budget(rows: DataFrame, by: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """The rows before the first that would exceed the budget, with running_total."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running_total", F.sum(size).over(upto)).where(F.col("running_total") <= budget)


def first_by(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key, the first by order; folded before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return best.select(*[F.col(c) if c in key else F.col("_r").getField(c).alias(c) for c in rows.columns])


def debounced(events: DataFrame, by: list[str], ts: str, gap: str) -> DataFrame:
    """One row per burst: events nearer than gap to the one before belong together; it fires at the end."""
    return events.groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(*by, F.col("w.start").alias("burst_start"), F.col("w.end").alias("fires_at"), "n_events")


def latest(rows: DataFrame, key: list[str], generation: Column) -> DataFrame:
    """Of each key the row of the newest generation; late results of older ones are dropped."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), generation).alias("_r"))
    return best.select(*[F.col(c) if c in key else F.col("_r").getField(c).alias(c) for c in rows.columns])


def settled(events: DataFrame, by: list[str], ts: str, seconds: int) -> DataFrame:
    """Events from `seconds` after the first of their group on, and of those before only the last (snapshot)."""
    group = Window.partitionBy(*by)
    opened = events.withColumn("_open", F.min(ts).over(group))
    early = F.col(ts) < F.col("_open") + F.make_interval(secs=F.lit(seconds))
    marked = opened.withColumn("_early", early)
    last = F.row_number().over(Window.partitionBy(*by, "_early").orderBy(F.desc(ts), *[F.desc(c) for c in events.columns if c not in (*by, ts)][:1]))
    return marked.withColumn("_n", last).where(~F.col("_early") | (F.col("_n") == 1)).select(*events.columns, F.col("_early").alias("snapshot"))
