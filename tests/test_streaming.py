import datetime as dt
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from quirelake.operators import runs
from quirelake.streaming import throttle as S
from quirelake.streaming.ledgers import Snapshots, changes

from .test_operators import EVENTS


def page(events, gap):
    """A page's own timer, event by event."""
    out, last, timer, value = [], None, None, None
    for t, v in events:
        if timer is not None and timer <= t:
            out.append((timer, value))
            last, timer = timer, None
        value = v
        if last is None or t - last >= gap:
            out.append((t, v))
            last = t
        else:
            timer = t + gap
    return out + ([(timer, value)] if timer is not None else [])


def scrolls(seed, n=400):
    r, t, rows = random.Random(seed), dict.fromkeys("abc", 0), []
    for i in range(n):
        k = r.choice("abc")
        t[k] += r.choice([5, 40, 200, 349, 350, 351, 900])
        rows.append((k, t[k], float(i)))
    return rows


def test_throttled(spark):
    rows = scrolls(1)
    got = S.throttled(spark.createDataFrame(rows, "k string, t long, v double"), "k", "t", "v", [], 350).collect()
    want = [(k, *x) for k in "abc" for x in page([(t, v) for q, t, v in rows if q == k], 350)]
    assert sorted((r.k, r.sent_at, r.v) for r in got) == sorted(want)


def test_throttled_stream_over_batches(spark, tmp_path):
    rows = scrolls(2, 60)
    for i in range(3):
        spark.createDataFrame(rows[20 * i : 20 * i + 20], "k string, t long, v double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("k string, t long, v double").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    query = S.throttled_stream(stream, "k", "t", "v", 350).writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    until = time.time() + 60  # timers keep such a query going, so it has no end to wait for
    while sum(p["numInputRows"] for p in query.recentProgress) < 60 and time.time() < until:
        time.sleep(0.2)
    query.stop()
    got = {(r.k, r.sent_at, r.v) for r in spark.table("sent").collect()}
    whole = {(k, *x) for k in "abc" for x in page([(t, v) for q, t, v in rows if q == k], 350)}
    first = {(k, min(t for q, t, _ in rows if q == k)) for k in "abc" if any(q == k for q, *_ in rows)}
    assert first <= {(k, t) for k, t, _ in got}
    assert len(got - whole) <= 9  # timers that fired between batches


def test_limited(spark):
    rows = [("a", 0, False), ("a", 100, False), ("a", 150, True), ("a", 290, False), ("a", 301, False), ("b", 5, False)]
    got = S.limited(spark.createDataFrame(rows, "k string, t long, reset boolean"), "k", "t", [], 150, "reset").collect()
    assert sorted((r.k, r.t) for r in got) == [("a", 0), ("a", 150), ("a", 301), ("b", 5)]


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_debounced_stream_equals_batch(spark, tmp_path):
    rows = [("f", at(x)) for x in (0, 100, 300, 800, 1049)] + [("g", at(50))]
    closing = [("z", at(60_000))]
    frame = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=["path", "ts"]))
    for i, part in enumerate((rows[:3], rows[3:], closing)):
        frame(part).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = frame(rows).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = changes(stream, ["path"], "ts").writeStream.format("memory").queryName("bursts").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    batch = runs.debounced(frame(rows), ["path"], "ts", "250 milliseconds").collect()
    assert sorted(map(tuple, spark.table("bursts").collect())) == sorted(map(tuple, batch)) and len(batch) == 3


def test_snapshots_fold_batches_once(spark, tmp_path):
    from quirelake.operators.positions import ledger

    r, rows = random.Random(5), []
    for i in range(90):
        kind = r.choice(["open", "store"])
        store = kind == "store"
        rows.append((r.choice("pqrs"), i, i, kind, None if store else r.choice(["", f"t{i}", None]), None if store else r.choice([f"a{i}", None]), None if store else r.choice([None, i]), f"x{i}" if store else None, 0.5 if store else None, i / 100 if store else None, float(i) if store else None))
    whole = spark.createDataFrame(rows, EVENTS)
    keep = Snapshots(spark, f"file://{tmp_path}")
    for b in range(3):
        part = whole.where(F.col("seq").between(30 * b, 30 * b + 29))
        keep(part, b)
        keep(part, b)  # a batch that runs again
    order = ledger(whole).columns
    assert sorted(map(repr, keep.read().select(*order).collect())) == sorted(map(repr, ledger(whole).collect()))
    assert runs.latest(spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z")], "k string, g int, v string"), ["k"], F.col("g")).first().v == "y"
