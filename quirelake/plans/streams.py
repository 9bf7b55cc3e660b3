"""Behaviour over time, over the events in batch; gaps are wide, for the events lie hours apart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..streaming import throttle as S
from .catalog import query, table
from .positions import MICROS

HOUR = 3_600_000_000


@query("debounce_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS burst_start, max(ts) + INTERVAL 1 HOUR AS fires_at, count(*) AS n_events FROM s GROUP BY user_id, k""")
def debounce_sessions(spark, sf_dir):
    return R.debounced(table(spark, sf_dir, "events"), ["user_id"], "ts", "1 hour")


@query("search_debounce", """WITH e AS (SELECT user_id, event_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT user_id, event_id, event_type AS q FROM e WHERE event_type <> 'error' AND (next IS NULL OR next - ts >= INTERVAL 1 HOUR)""")
def search_debounce(spark, sf_dir):
    """A query runs if nothing follows it within the gap; an empty one (here: error) only cancels."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "events").withColumn("us", F.expr(MICROS))
    after = F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    rows = rows.withColumn("after", after).where("event_type <> 'error' AND (after IS NULL OR after - us >= 3600000000)")
    return rows.select("user_id", "event_id", F.col("event_type").alias("q"))


_G = 6 * HOUR
THROTTLE = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, epoch_us(ts) AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, n, last, timer, fired, sent, value, old) AS (
  SELECT user_id, n, t, NULL::BIGINT, NULL::BIGINT, t, value, NULL::DOUBLE FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.n, CASE WHEN e.t - l >= {_G} THEN e.t ELSE l END, CASE WHEN e.t - l >= {_G} THEN CASE WHEN f THEN NULL ELSE timer END ELSE e.t + {_G} END,
    CASE WHEN f THEN timer END, CASE WHEN e.t - l >= {_G} THEN e.t END, e.value, x.value
  FROM (SELECT r.*, e.t AS now, r.timer IS NOT NULL AND r.timer <= e.t AS f, CASE WHEN r.timer IS NOT NULL AND r.timer <= e.t THEN r.timer ELSE r.last END AS l FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) x
  JOIN e ON e.user_id = x.user_id AND e.n = x.n + 1)
SELECT user_id, fired AS sent_at, old AS value FROM r WHERE fired IS NOT NULL
UNION ALL SELECT user_id, sent, value FROM r WHERE sent IS NOT NULL
UNION ALL SELECT user_id, timer, value FROM r WHERE timer IS NOT NULL AND n = (SELECT max(n) FROM e WHERE e.user_id = r.user_id)"""


@query("throttle_positions", THROTTLE)
def throttle_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("us", F.expr(MICROS))
    return S.throttled(rows, "user_id", "us", "value", ["event_id"], _G)


ZOOM_LIMIT = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'signup' AS reset, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(user_id, n, us, reset, last, passes) AS (SELECT user_id, n, us, reset, us, true FROM e WHERE n = 1 UNION ALL
SELECT e.user_id, e.n, e.us, e.reset, CASE WHEN e.reset OR e.us - r.last > {HOUR} THEN e.us ELSE r.last END, e.reset OR e.us - r.last > {HOUR} FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, us, reset FROM r WHERE passes"""


@query("zoom_limit", ZOOM_LIMIT)
def zoom_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(MICROS).alias("us"), (F.col("event_type") == "signup").alias("reset"))
    return S.limited(rows, "user_id", "us", ["event_id"], HOUR, "reset")


@query("late_generation", "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type")
def late_generation(spark, sf_dir):
    return R.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


@query("warm_up", """WITH o AS (SELECT user_id, event_id, ts, ts < min(ts) OVER (PARTITION BY user_id) + INTERVAL 2 DAY AS early FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, early ORDER BY ts DESC, event_id DESC) AS n FROM o) SELECT user_id, event_id, early AS snapshot FROM k WHERE NOT early OR n = 1""")
def warm_up(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return R.settled(rows, ["user_id"], "ts", 2 * 86400).select("user_id", "event_id", "snapshot")
