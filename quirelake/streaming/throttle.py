"""Rate limits of a reader: a leading send, then one `gap` after the last event of a burst.

The same step serves batches and streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass
class State:
    """When something was last sent, when the timer fires (if it runs), and the newest value."""

    last: int | None = None
    timer: int | None = None
    value: float | None = None

    def fire(self, now: int | None) -> Iterator[tuple[int, float]]:
        """What the timer sends up to now; all of it without now."""
        if self.timer is not None and (now is None or self.timer <= now):
            self.last, self.timer = self.timer, None
            yield self.last, self.value

    def see(self, t: int, value: float, gap: int) -> Iterator[tuple[int, float]]:
        yield from self.fire(t)
        self.value = value
        if self.last is None or t - self.last >= gap:
            self.last = t
            yield t, value
        else:
            self.timer = t + gap


def throttled(events: DataFrame, key: str, t: str, value: str, order: list[str], gap: int) -> DataFrame:
    """(key, sent_at, value) of each key's events, t and gap in the same unit.

    Keys are dealt to tasks and sorted; a task goes through its rows once and holds one state, so a
    key of any size fits. Null values are sent like others.
    """
    rows = events.select(F.col(key).alias("_key"), F.col(t).cast("long").alias("_t"), F.col(value).cast("double").alias("_value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "_t", *[f"_o{i}" for i in range(len(order))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, state = None, State()
        for batch in batches:
            out = []
            for k, at, v in zip(batch["_key"], batch["_t"], batch["_value"], strict=True):
                if k != here:
                    out += [(here, *x) for x in state.fire(None)]
                    here, state = k, State()
                out += [(k, *x) for x in state.see(at, v, gap)]
            yield pd.DataFrame(out, columns=[key, "sent_at", value])
        yield pd.DataFrame([(here, *x) for x in state.fire(None)], columns=[key, "sent_at", value])

    kind = events.schema[key].dataType.simpleString()
    return ordered.select("_key", "_t", "_value").mapInPandas(run, f"{key} {kind}, sent_at long, {value} double")


def limited(events: DataFrame, key: str, t: str, order: list[str], gap: int, exempt: str) -> DataFrame:
    """(key, t, exempt) of the commands that pass: more than gap after the last that did, or exempt ones, which always pass."""
    rows = events.select(key, t, exempt, *[c for c in order if c not in (key, t, exempt)]).repartition(key).sortWithinPartitions(key, t, *order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = None, None
        for batch in batches:
            keep = []
            for k, at, free in zip(batch[key], batch[t], batch[exempt], strict=True):
                if k != here:
                    here, last = k, None
                passes = bool(free) or last is None or at - last > gap
                last = at if passes else last
                keep.append(passes)
            yield batch.loc[keep, [key, t, exempt]]

    return rows.mapInPandas(run, rows.select(key, t, exempt).schema)


def throttled_stream(events: DataFrame, key: str, t: str, value: str, gap: int) -> DataFrame:
    """The same for a stream, t and gap in milliseconds; a timer fires when processing time passes the gap."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = State(*group.get) if group.exists else State()
        out = list(state.fire(None)) if group.hasTimedOut else []
        rows = pd.concat(list(frames)) if not group.hasTimedOut else None
        if rows is not None and len(rows):
            for at, v in rows.sort_values(t, kind="stable")[[t, value]].itertuples(index=False):
                out += state.see(int(at), float(v), gap)
        group.update((state.last, state.timer, state.value))
        if state.timer is not None:
            group.setTimeoutDuration(max(1, gap))
        yield pd.DataFrame([(k[0], *x) for x in out], columns=[key, "sent_at", value])

    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, sent_at long, {value} double", "last long, timer long, value double", "append", GroupStateTimeout.ProcessingTimeTimeout)
