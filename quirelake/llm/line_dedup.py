"""Line dedup by winnowing over line hashes.

Of every `run` consecutive lines the least hash is a fingerprint, so two texts that share such a run
share its fingerprint. Only these minima are kept as positions. Positions meet by fingerprint; those
that repeat are extended both ways to the runs whose minimum they are, and of equal runs all but the
first are deleted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged, table, text_of

#: Consecutive lines that make a run; characters of a line that is a run of its own.
RUN, LONG = 2, 200


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.translate(line, " \t\r", "") == ""


def _shifted(array: Column, n: int, merge) -> Column:
    """merge() folded over every n consecutive entries."""
    size = F.greatest(F.size(array) - (n - 1), F.lit(0))
    return F.slice(reduce(lambda z, j: F.zip_with(z, F.slice(array, j + 1, F.greatest(F.size(array) - j, F.lit(0))), merge), range(1, n), array), 1, size)


def _met(rows: DataFrame, folded: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join that deals both sides anew, by one key more than folded was dealt by, so Spark can split a hot key."""
    again = F.shiftright("h", 1)
    return rows.withColumn("_h", again).join(folded.withColumn("_h", again), [*on, "_h"], how).drop("_h")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, long: int = LONG, counts: tuple[str, str] = ("_n_lines", "_n_removed")) -> DataFrame:
    """docs with text_col rid of repeated runs, and how many lines it had and lost, in columns that counts names.

    Lines end at line feeds; lines of white space only are no part of a run and stay. A line goes if
    it lies in `run` consecutive lines that also start at an earlier place: a smaller id, or the same
    document further up. A line of at least `long` characters goes on its own account too if it
    stands at an earlier place. All is judged on the input, runs may overlap. A null id comes first.
    Rows with equal id and equal text are one document and fare alike. A null text stays null; a text
    whose lines all go becomes empty; one of any length is read whole. Lines are compared by the MD5
    of their MD5s. A column of docs named like one of counts gives way to it.

    Each step folds what it can before a shuffle: fingerprints are counted and first places are
    taken in the map tasks, so a line that a third of the documents hold sends one row per task.
    Positions are written once; the rest is one query.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {x.lower() for x in counts}])
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(text_of(text_col)))))
    full = F.filter(_lines(text_of(text_col)), lambda x: ~_blank(x))
    # inline() keeps the optimizer from repeating the split in each use of its result
    marks = F.transform(full, lambda x: F.struct(F.md5(x).alias("sum"), F.xxhash64(x).alias("h"), (F.length(x) >= long).alias("long")))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("k"), F.inline(F.array(F.struct(marks.alias("marks"))))).where(F.size("marks") > 0)
    windows = F.arrays_zip(_shifted(F.col("marks.sum"), run, lambda a, b: F.concat(a, b)).alias("run"), _shifted(F.col("marks.h"), run, lambda a, b: F.least(a, b)).alias("least"))
    windows = F.transform(windows, lambda x, s: F.struct(s.alias("p"), F.lit(run).alias("n"), F.unhex(F.md5(x["run"])).alias("run"), x["least"].alias("least")))
    rows = rows.select("id", "k", "marks", F.inline(F.array(F.struct(windows.alias("windows")))))

    def extent(x: Column, i: Column) -> Column:
        """The runs around place i whose least hash it has, and the line itself if it is long."""
        start = F.greatest(i - (run - 1), F.lit(0))
        around = F.slice(F.col("windows"), start + 1, F.greatest(F.least(i + 1, F.size("windows")) - start, F.lit(0)))
        mine = F.filter(around, lambda w: w["least"] == x["h"])
        own = F.struct(i.alias("p"), F.lit(1).alias("n"), F.unhex(F.md5(F.concat(F.lit("line "), x["sum"]))).alias("run"), x["h"].alias("least"))
        return F.when(x["long"], F.concat(mine, F.array(own))).otherwise(mine)

    positions = F.filter(F.transform("marks", lambda x, i: F.struct(x["h"].alias("h"), i.alias("at"), extent(x, i).alias("runs"))), lambda x: F.size(x["runs"]) > 0)
    places = staged(rows.select("id", "k", F.explode(positions).alias("x")).select("id", "k", "x.h", "x.at", F.transform("x.runs", lambda w: F.struct(w["p"].alias("p"), w["n"].alias("n"), w["run"].alias("run"))).alias("runs")), "places")
    chosen = places.groupBy("h").agg(F.min(F.xxhash64("k", "at")).alias("a"), F.max(F.xxhash64("k", "at")).alias("b"))
    met = _met(places, chosen.where("a <> b").select("h"), ["h"], "left_semi").select("id", "k", "h", F.inline("runs"))
    first = met.groupBy("h", "run").agg(F.min(F.struct("id", "k", "p")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("h", "run", "first")
    later = _met(met, first, ["h", "run"], "inner").where(F.struct("id", "k", "p") > F.col("first"))
    gone = later.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("p", F.col("p") + F.col("n") - 1)))).alias("gone"))
    # lines are columns of the join's input, so no lambda below splits a text again
    others = [c for c in docs.columns if c != text_col]
    split = docs.select(F.struct(*[F.col(f"`{c}`") for c in others], *[F.lit(0).alias("_")] * (not others)).alias("row"), key.alias("k"), _lines(F.col(text_col)).alias("lines"))
    split = split.withColumn("held", F.filter(F.transform("lines", lambda x, i: F.when(~_blank(x), i)), lambda i: i.isNotNull()))
    joined = split.join(gone.hint("merge"), "k", "left")
    out = F.transform("gone", lambda i: F.element_at("held", i + 1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), out)
    kept = F.transform(left, lambda i: F.element_at("lines", i + 1))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n").alias(text_col)
    columns = [text if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size("held"), F.lit(0)).cast("long").alias(counts[0]), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias(counts[1]))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(text_of(), 256).alias("kept_sha256"))


SQL = rf"""
WITH d AS MATERIALIZED (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
l AS MATERIALIZED (SELECT doc_id, t, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS raw FROM d),
f AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, t ORDER BY raw) AS p FROM l WHERE translate(line, chr(32) || chr(9) || chr(13), '') <> ''),
w AS MATERIALIZED (
  SELECT doc_id, t, p, {RUN} AS n, md5({" || chr(10) || ".join(f"lead(line, {j}) OVER g" for j in range(RUN))}) AS s FROM f WINDOW g AS (PARTITION BY doc_id, t ORDER BY p)
  UNION ALL SELECT doc_id, t, p, 1, md5(line) FROM f WHERE length(line) >= {LONG}),
r AS MATERIALIZED (SELECT doc_id, t, p, n FROM (SELECT *, row_number() OVER (PARTITION BY n, s ORDER BY doc_id NULLS FIRST, md5(t), p) AS k FROM w WHERE s IS NOT NULL) WHERE k > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, t, unnest(range(p, p + n)) AS p FROM r),
c AS (
  SELECT l.doc_id, l.t, count(f.p) AS n_lines, count(gone.p) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.raw) FILTER (WHERE gone.p IS NULL), '') AS kept
  FROM l LEFT JOIN f ON l.doc_id IS NOT DISTINCT FROM f.doc_id AND l.t = f.t AND l.raw = f.raw
  LEFT JOIN gone ON f.doc_id IS NOT DISTINCT FROM gone.doc_id AND f.t = gone.t AND f.p = gone.p GROUP BY l.doc_id, l.t)
SELECT x.doc_id, c.n_lines, c.n_removed, sha256(c.kept) AS kept_sha256
FROM documents x JOIN c ON x.doc_id IS NOT DISTINCT FROM c.doc_id AND coalesce(x.text, '') = c.t
"""
