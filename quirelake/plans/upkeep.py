"""Repeats, retries, caches and queues over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import upkeep as U
from .catalog import query, table


@query("hold_to_repeat", "SELECT event_id, [0::BIGINT] || coalesce(list_transform(range(1, greatest(ceil(((event_id % 1999) - 450) / 250.0)::BIGINT - 1, 0) + 1), lambda k: 450 + 250 * k), []) AS steps FROM events")
def hold_to_repeat(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", U.steps(F.col("event_id") % 1999).alias("steps"))


@query("restore_attempts", "SELECT event_id, list_filter([30, 200, 500, 1000, 1800, 2600]::BIGINT[], lambda x: event_type = 'view' OR x < event_id % 3000) AS attempts FROM events")
def restore_attempts(spark, sf_dir):
    scrolled = F.when(F.col("event_type") != "view", F.col("event_id") % 3000)
    return table(spark, sf_dir, "events").select("event_id", U.restores(scrolled).alias("attempts"))


@query("file_retries", "SELECT event_id, CASE WHEN event_type <> 'error' AND ceil((event_id % 2500) / 100.0) <= 20 THEN ceil((event_id % 2500) / 100.0)::INT END AS retries FROM events")
def file_retries(spark, sf_dir):
    gone = F.when(F.col("event_type") != "error", F.col("event_id") % 2500)
    return table(spark, sf_dir, "events").select("event_id", U.delivered(gone).alias("retries"))


_KEPT = "SELECT user_id, event_id, 1000000 + (event_id * 7919) % 4000000 AS pixels, event_id % 5 = 0 AS seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 14"


@query("cache_eviction", f"""WITH k AS ({_KEPT}),
o AS (SELECT *, count(*) OVER u - row_number() OVER w + 1 AS n_left, sum(pixels) OVER u - sum(pixels) OVER w + pixels AS load FROM k WINDOW u AS (PARTITION BY user_id), w AS (PARTITION BY user_id ORDER BY seen::INT, event_id)),
g AS (SELECT *, (n_left > 10 OR load > 24000000) AND NOT (seen AND n_left <= 2) AS go FROM o)
SELECT user_id, event_id, pixels::BIGINT AS pixels FROM (SELECT *, min(go::INT) OVER (PARTITION BY user_id ORDER BY seen::INT, event_id) AS every FROM g) WHERE every = 1""")
def cache_eviction(spark, sf_dir):
    """The 14 newest events of a user stand for cached pages."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    kept = table(spark, sf_dir, "events").withColumn("k", newest).where("k <= 14")
    kept = kept.select("user_id", "event_id", (F.lit(1000000) + F.col("event_id") * 7919 % 4000000).alias("pixels"), (F.col("event_id") % 5 == 0).alias("seen"))
    return U.released(kept, ["user_id"], "event_id", "pixels", "seen").select("user_id", "event_id", "pixels")


@query("decode_queue", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY abs(500 * turn + length(text) / 2.0 - 700), turn)::INT AS place FROM conversations")
def decode_queue(spark, sf_dir):
    frames = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 500).alias("top"), F.length("text").alias("height"))
    return U.wanted(frames, ["conv_id"], "top", "height", F.lit(700), "turn").select("conv_id", "turn", "place")


@query("stale_folders", "SELECT event_id FROM events WHERE event_type LIKE 'c%' AND event_id <> 7 AND (event_id % 10 = 0 OR ts < TIMESTAMP '2024-01-02')")
def stale_folders(spark, sf_dir):
    name = F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"))
    folders = table(spark, sf_dir, "events").select("event_id", name.alias("name"), F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp_ntz")).alias("modified"))
    return U.stale(folders, "name", "modified", "c", F.lit("click-7"), F.lit("2024-01-02").cast("timestamp_ntz")).select("event_id")


@query("shared_dictionaries", "SELECT a.o_custkey, a.o_orderkey AS component, b.o_orderkey AS dictionary FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey")
def shared_dictionaries(spark, sf_dir):
    """Each order includes the one before it of the same customer, and the first the last: a circle."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    last = F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.coalesce(F.lag("o_orderkey").over(order), last).alias("before"))
    return U.dictionaries(rows, ["o_custkey"], "o_orderkey", "before")
