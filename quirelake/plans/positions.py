"""Reading positions, with events as openings and stored places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import positions as P
from .catalog import query, table

MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))"


def events(spark, sf_dir):
    """A path per user; views and clicks open, the rest stores."""
    rows = table(spark, sf_dir, "events").withColumn("us", F.expr(MICROS))
    opened = F.col("event_type").isin("view", "click")
    return rows.select(
        F.concat(F.lit("/books/"), F.col("user_id").cast("string")).alias("path"),
        F.expr("us div 1000000").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(opened, "open").otherwise("store").alias("kind"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "").alias("title"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a"), F.col("event_id").cast("string"))).alias("author"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7).alias("size"),
        F.concat(F.lit("ch"), (F.col("event_id") % 9).cast("string")).alias("anchor"),
        (F.col("value") / 1000).alias("section_offset"),
        (F.col("value") / 500).alias("fraction"),
        F.col("value").alias("scroll_y"),
    )


_E = """SELECT '/books/' || user_id AS path, epoch_us(ts) // 1000000 AS ts, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'open' ELSE 'store' END AS kind,
CASE event_id % 3 WHEN 0 THEN 't' || event_id WHEN 1 THEN '' END AS title, CASE WHEN event_id % 2 = 0 THEN 'a' || event_id END AS author, CASE WHEN event_id % 5 <> 0 THEN event_id % 7 END AS size,
'ch' || event_id % 9 AS anchor, value / 1000 AS section_offset, value / 500 AS fraction, value AS scroll_y FROM events"""
_LAST = lambda c, cond: f"(list({c} ORDER BY ts DESC, seq DESC) FILTER (WHERE {cond}))[1]"
LEDGER = f"""SELECT path, {_LAST('title', "kind = 'open' AND title <> ''")} AS title, {_LAST('author', "kind = 'open' AND author <> ''")} AS author, {_LAST('size', "kind = 'open'")} AS size,
{_LAST('anchor', "kind = 'store'")} AS anchor, {_LAST('section_offset', "kind = 'store'")} AS section_offset, {_LAST('fraction', "kind = 'store'")} AS fraction, {_LAST('scroll_y', "kind = 'store'")} AS scroll_y,
count(*) FILTER (WHERE kind = 'open') AS opens, CASE WHEN (list(kind ORDER BY ts, seq))[1] = 'open' THEN min(ts) ELSE 0 END AS first_read, max(ts) FILTER (WHERE kind = 'open') AS last_read, max(ts) AS updated FROM ({_E}) GROUP BY path"""


def ledger(spark, sf_dir):
    return P.ledger(events(spark, sf_dir))


query("position_ledger", LEDGER)(ledger)


@query("size_guard", f"SELECT path, size, opens FROM ({LEDGER}) WHERE size IS NULL OR size = 3")
def size_guard(spark, sf_dir):
    return P.lookup(ledger(spark, sf_dir), F.col("path"), F.lit(3)).select("path", "size", "opens")


@query("prune_keep_newest", f"SELECT path, updated FROM (SELECT *, row_number() OVER (ORDER BY updated DESC, path) AS k FROM ({LEDGER})) WHERE k <= 50")
def prune_keep_newest(spark, sf_dir):
    return P.pruned(ledger(spark, sf_dir), [F.desc("updated"), F.col("path")], 50).select("path", "updated")


@query("recent_history", f"SELECT right(path, 45) AS path, to_timestamp(updated)::DATE AS day, round(fraction, 3) AS fraction, opens FROM (SELECT * FROM ({LEDGER}) ORDER BY updated DESC, path LIMIT 20)")
def recent_history(spark, sf_dir):
    newest = ledger(spark, sf_dir).orderBy(F.desc("updated"), "path").limit(20)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.expr("cast(updated div 86400 as int)"))
    return newest.select(F.right("path", F.lit(45)).alias("path"), day.alias("day"), F.round("fraction", 3).alias("fraction"), "opens")


# Steps of the zoom.
ZOOM = [0.5, 0.67, 0.8, 0.9, 1.0, 1.1, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0]


@query("zoom_nearest", f"SELECT event_id, (SELECT arg_min(z, abs(value / 50 - z)) FROM (SELECT unnest({ZOOM}::DOUBLE[]) AS z)) AS zoom FROM events")
def zoom_nearest(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", P.nearest(F.col("value") / 50, ZOOM).alias("zoom"))


_MARKS = "SELECT user_id, value AS offset_px, event_id AS mark FROM events WHERE event_type = 'view'"


@query("asof_anchor", f"""WITH m AS (SELECT user_id, epoch_us(ts) AS at, max(event_id) AS mark FROM events WHERE event_type = 'view' GROUP BY ALL), p AS (SELECT event_id, user_id, epoch_us(ts) AS at FROM events WHERE event_type = 'click')
SELECT p.event_id, m.mark FROM p ASOF LEFT JOIN m ON p.user_id = m.user_id AND p.at >= m.at""")
def asof_anchor(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("at", F.expr(MICROS))
    marks = rows.where("event_type = 'view'").select("user_id", F.col("at").alias("mark_at"), F.col("event_id").alias("mark"))
    return P.asof(rows.where("event_type = 'click'").select("event_id", "user_id", "at"), marks, ["user_id"], "at", "mark_at", ["mark"]).select("event_id", "mark")


@query("scroll_anchor", """WITH m AS (SELECT conv_id, turn, (turn * 100)::DOUBLE AS top, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) * 100, 2000)::DOUBLE AS bottom FROM conversations),
p AS (SELECT event_id, user_id AS conv_id, value AS scroll FROM events)
SELECT p.event_id, m.turn, CASE WHEN m.turn IS NOT NULL THEN round(least(1, greatest(0, (p.scroll - m.top) / greatest(1, m.bottom - m.top))), 6) END AS section_offset FROM p ASOF LEFT JOIN m ON p.conv_id = m.conv_id AND p.scroll + 2 >= m.top""")
def scroll_anchor(spark, sf_dir):
    from ..operators.outline import extents

    tops = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 100).cast("double").alias("top"))
    marks = extents(tops, ["conv_id"], "top", F.lit(2000.0))
    points = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("conv_id"), F.col("value").alias("scroll"))
    found = P.asof(points, marks, ["conv_id"], "scroll", "top", ["top", "extent_end", "turn"], tolerance=2.0)
    share = (F.col("scroll") - F.col("top")) / F.greatest(F.lit(1.0), F.col("extent_end") - F.col("top"))
    within = F.when(F.col("turn").isNotNull(), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)), 6))
    return found.select("event_id", "turn", within.alias("section_offset"))


@query("reading_line", """SELECT p.event_id, m.turn FROM (SELECT event_id, user_id AS conv_id, value + 100 AS line FROM events) p ASOF LEFT JOIN (SELECT conv_id, turn, (turn * 100)::DOUBLE AS top FROM conversations) m ON p.conv_id = m.conv_id AND p.line >= m.top""")
def reading_line(spark, sf_dir):
    marks = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 100).alias("top"))
    points = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("conv_id"), F.col("value").alias("scroll"))
    return P.asof(points, marks, ["conv_id"], "scroll", "top", ["turn"], tolerance=100.0).select("event_id", "turn")
