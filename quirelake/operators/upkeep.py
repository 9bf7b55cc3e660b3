"""What a reader does around its books: repeats, retries, caches, queues, old folders, settings, shared dictionaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in milliseconds: a held button, attempts to restore a position, attempts to find a file again.
HOLD, REPEAT = 450, 250
RESTORE = [30, 200, 500, 1000, 1800, 2600]
RETRY, RETRIES = 100, 20
# Pixels and pages that a cache of page images keeps.
PIXELS, PAGES = 24_000_000, 10


def steps(held_for: Column) -> Column:
    """When a button that is held so long steps: at once, and from HOLD on every REPEAT until it is let go."""
    n = F.greatest(F.ceil((held_for - HOLD) / F.lit(REPEAT)) - 1, F.lit(0)).cast("int")
    return F.concat(F.array(F.lit(0).cast("long")), F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: (k * REPEAT + HOLD).cast("long"))).otherwise(F.array().cast("array<long>")))


def restores(input_at: Column) -> Column:
    """When a position is applied again while a page settles: until the reader scrolls (null: never)."""
    return F.filter(F.array(*[F.lit(x).cast("long") for x in RESTORE]), lambda x: input_at.isNull() | (x < input_at))


def delivered(gone_for: Column) -> Column:
    """How many retries a file that is gone for so long takes to be found; null where it is given up (null: for good)."""
    n = F.greatest(F.ceil(gone_for / F.lit(RETRY)), F.lit(0)).cast("int")
    return F.when(gone_for.isNotNull() & (n <= RETRIES), n)


def released(kept: DataFrame, by: list[str], used: str, pixels: str, seen: str, pages: int = PAGES, budget: int = PIXELS) -> DataFrame:
    """The cached pages that go: unseen ones first, least recently used first, while there are too many or they are too large.

    Pages on screen stay when only two are left. A page goes only if all before it in that order go.
    """
    order = Window.partitionBy(*by).orderBy(F.col(seen).cast("int"), used)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    left = F.count(F.lit(1)).over(whole) - F.coalesce(F.count(F.lit(1)).over(before), F.lit(0))
    load = F.sum(pixels).over(whole) - F.coalesce(F.sum(pixels).over(before), F.lit(0))
    go = ((left > pages) | (load > budget)) & ~(F.col(seen) & (left <= 2))
    found = kept.withColumn("_go", go)
    return found.withColumn("_all", F.min(F.col("_go").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_all = 1").drop("_go", "_all")


def wanted(frames: DataFrame, by: list[str], top: str, height: str, line: Column, tie: str) -> DataFrame:
    """frames with place: the order in which they are decoded, nearest to the reading line first."""
    distance = F.abs(F.col(top) + F.col(height) / 2 - line)
    return frames.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(distance, tie)))


def stale(folders: DataFrame, name: str, modified: str, prefix: str, current: Column, cutoff: Column) -> DataFrame:
    """Work folders that can go: of that prefix, not the current one, last changed before cutoff or at an unknown time."""
    return folders.where(F.col(name).startswith(prefix) & ~F.col(name).eqNullSafe(current) & F.coalesce(F.col(modified) < cutoff, F.lit(True)))


def write_settings(settings: DataFrame, folders: list[str]) -> list[str]:
    """Settings as JSON in each folder that can be written; returns those. Spark's writer renames, so readers see old or new."""
    done = []
    for folder in folders:
        try:
            settings.coalesce(1).write.mode("overwrite").json(folder)
            done.append(folder)
        except Exception:  # best effort: a folder that is missing or closed must not stop the others
            continue
    return done


def dictionaries(includes: DataFrame, by: list[str], component: str, included: str) -> DataFrame:
    """(by, component, dictionary): all that a component includes, directly or through others, each once even in a circle.

    A file's components are folded in one task, so by has to name the file.
    """
    kind = includes.schema[component].dataType.simpleString()
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in includes.select(*by).schema) + f", component {kind}, dictionary {kind}"

    def fold(data: pa.Table) -> pa.Table:
        below: dict = {}
        for a, b in zip(data.column(component).to_pylist(), data.column(included).to_pylist(), strict=True):
            below.setdefault(a, []).append(b)
        rows = []
        for start in below:
            seen, todo = set(), [start]
            while todo:
                for x in below.get(todo.pop(), ()):
                    if x is not None and x not in seen:
                        seen.add(x)
                        todo.append(x)
            rows += [(start, x) for x in seen]
        names = {c: pa.array([data.column(c)[0].as_py()] * len(rows), data.schema.field(c).type) for c in by}
        own = data.schema.field(component).type
        return pa.table(names | {"component": pa.array([a for a, _ in rows], own), "dictionary": pa.array([b for _, b in rows], own)})

    return includes.groupBy(*by).applyInArrow(fold, schema)
