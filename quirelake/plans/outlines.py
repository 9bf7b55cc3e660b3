"""Outlines of pages and of conversations, whose turns stand for headings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import apply_sql
from ..operators import guess as G
from ..operators import outline as O
from ..operators import runs as R
from .catalog import query, table
from .texts import collapsed_sql

# A turn stands for a heading of level 1 to 3, by the length of its text.
_ENTRIES = "SELECT conv_id, turn AS idx, (1 + length(text) % 3)::INT AS level, text AS title FROM conversations"


def entries(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), (1 + F.length("text") % 3).cast("int").alias("level"), F.col("text").alias("title"))


_H = r"'(?is)<h1[^>]{0,400}>.{0,600}?</h1\s*>|<h2[^>]{0,400}>.{0,600}?</h2\s*>|<h3[^>]{0,400}>.{0,600}?</h3\s*>'"
_HEADINGS = rf"""
WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, {_H})) AS m, generate_subscripts(regexp_extract_all(html, {_H}), 1) AS o FROM pages),
t AS (SELECT page_id, o, substr(m, 3, 1)::INT AS level, {collapsed_sql('m')} AS title, regexp_extract(regexp_extract(m, '(?is)^<h[1-3]([^>]{{0,400}})>', 1), '(?i)\bid\s*=\s*["'']([^"''<>]{{1,200}})["'']', 1) AS id FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS k FROM t WHERE title <> '')
SELECT page_id, 0::BIGINT AS section_idx, k::BIGINT AS heading_idx, level, title, coalesce(nullif(id, ''), 'ch0--h' || k) AS anchor FROM n WHERE k < 800"""


@query("headings", _HEADINGS)
def headings(spark, sf_dir):
    return O.headings(table(spark, sf_dir, "pages"), ["page_id"], None, "html")


@query("headings_of_sections", """
WITH e AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations WHERE trim(regexp_replace(text, '[\\x{9}-\\x{D}\\x{20}\\x{85}\\p{Z}]+', ' ', 'g')) <> '' AND length(text) <= 600)
SELECT conv_id, turn AS section_idx, k::BIGINT AS heading_idx, CASE role WHEN 'user' THEN 1 ELSE 2 END::INT AS level, """ + collapsed_sql("text") + """ AS title, 'ch' || turn || '--h' || k AS anchor FROM e WHERE k < 800""")
def headings_of_sections(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "user", "1").otherwise("2")
    return O.headings(turns.withColumn("html", F.concat(F.lit("<h"), level, F.lit(">"), "text", F.lit("</h"), level, F.lit(">"))), ["conv_id"], "turn", "html")


@query("outline_parent", f"""WITH e AS ({_ENTRIES})
SELECT conv_id, idx, level, (SELECT max(p.idx) FROM e p WHERE p.conv_id = e.conv_id AND p.idx < e.idx AND p.level < e.level) AS parent_idx FROM e""")
def outline_parent(spark, sf_dir):
    return O.parents(entries(spark, sf_dir), ["conv_id"], "idx", "level", 3).select("conv_id", "idx", "level", "parent_idx")


@query("fold_extent", f"""WITH e AS ({_ENTRIES})
SELECT conv_id, idx, level, (SELECT min(p.idx) FROM e p WHERE p.conv_id = e.conv_id AND p.idx > e.idx AND p.level <= e.level) AS fold_end FROM e""")
def fold_extent(spark, sf_dir):
    return O.folds(entries(spark, sf_dir), ["conv_id"], "idx", "level", 3).select("conv_id", "idx", "level", "fold_end")


@query("section_extent", f"WITH e AS ({_ENTRIES}) SELECT conv_id, idx, coalesce(lead(idx) OVER (PARTITION BY conv_id ORDER BY idx), 9999) AS extent_end FROM e")
def section_extent(spark, sf_dir):
    return O.extents(entries(spark, sf_dir), ["conv_id"], "idx", F.lit(9999).cast("long")).select("conv_id", "idx", "extent_end")


@query("outline_size", "SELECT conv_id, count(*) AS entries, max(turn) AS last_entry, count(*) FILTER (WHERE role = 'user') AS of_user FROM conversations GROUP BY conv_id")
def outline_size(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("entries"), F.max("turn").alias("last_entry"), F.count_if(F.col("role") == "user").alias("of_user"))


_DECLARED = r"len(regexp_extract_all(regexp_extract(html, '(?is)<nav\b.*?</nav>', 0), '(?i)<a\s'))"


@query("toc_choice", f"""SELECT page_id, {_DECLARED}::BIGINT AS declared, len(regexp_extract_all(html, '(?i)<p\\b'))::BIGINT AS derived,
CASE WHEN {_DECLARED} = 0 THEN 'derived' WHEN page_id % 2 = 0 AND len(regexp_extract_all(html, '(?i)<p\\b')) > {_DECLARED} THEN 'derived' ELSE 'declared' END AS choice FROM pages""")
def toc_choice(spark, sf_dir):
    declared = F.size(F.regexp_extract_all(F.regexp_extract("html", r"(?is)<nav\b.*?</nav>", 0), F.lit(r"(?i)<a\s"), F.lit(0))).cast("long")
    derived = F.size(F.regexp_extract_all("html", F.lit(r"(?i)<p\b"), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", declared.alias("declared"), derived.alias("derived"), O.choose(declared, derived, F.col("page_id") % 2 == 0).alias("choice"))


@query("page_contents", "SELECT conv_id, CASE WHEN count(*) FILTER (WHERE role = 'system') > 0 THEN 'declared' WHEN count(*) <= 1 THEN 'none' ELSE 'pages' END AS contents FROM conversations GROUP BY conv_id")
def page_contents(spark, sf_dir):
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "system").alias("d"), F.count(F.lit(1)).alias("n"))
    return counts.select("conv_id", O.page_contents(F.col("d"), F.col("n")).alias("contents"))


@query("slug_suffix", "SELECT conv_id, idx, CASE WHEN k = 0 THEN s ELSE s || '-' || k END AS slug FROM (SELECT conv_id, turn AS idx, s, row_number() OVER (PARTITION BY conv_id, s ORDER BY turn) - 1 AS k FROM (SELECT conv_id, turn, " + apply_sql("lower(left(text, 2))", T.SLUG) + " AS s FROM conversations))")
def slug_suffix(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumn("s", T.slug(F.left("title", F.lit(2))))
    return O.numbered(rows, ["conv_id"], "s", ["idx"]).select("conv_id", "idx", "slug")


@query("spliced_tree", """WITH RECURSIVE n AS (SELECT conv_id, turn AS idx, CASE WHEN length(text) % 3 = 0 THEN '' ELSE text END AS title, CASE WHEN (turn * 7 + length(text)) % 5 < turn THEN (turn * 7 + length(text)) % 5 END AS parent FROM conversations),
u AS (SELECT conv_id, idx, title, parent AS a, 0 AS h FROM n WHERE title <> '' UNION ALL SELECT u.conv_id, u.idx, u.title, n.parent, u.h + 1 FROM u JOIN n ON n.conv_id = u.conv_id AND n.idx = u.a WHERE n.title = '')
SELECT conv_id, idx, title, p.parent_idx FROM (SELECT conv_id, idx, title, arg_max_null(a, h) AS parent_idx FROM u GROUP BY conv_id, idx, title) AS p""")
def spliced_tree(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    nodes = turns.select("conv_id", F.col("turn").alias("idx"), F.when(F.length("text") % 3 == 0, "").otherwise(F.col("text")).alias("title"), ((F.col("turn") * 7 + F.length("text")) % 5).cast("long").alias("parent_idx"))
    return O.spliced(nodes, ["conv_id"])


@query("budget_cut", "SELECT conv_id, turn, running_total FROM (SELECT conv_id, turn, sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS running_total FROM conversations) WHERE running_total <= 600")
def budget_cut(spark, sf_dir):
    return R.within_budget(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.octet_length("text").cast("long"), 600).select("conv_id", "turn", "running_total")


_RUNS = "SELECT doc_id, source, lang, row_number() OVER w AS n, CASE WHEN lag(lang) OVER w IS NOT DISTINCT FROM lang AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)"


@query("folder_runs", f"SELECT source, run, lang, min(doc_id) AS first_id, count(*) AS n FROM (SELECT *, (sum(new) OVER (PARTITION BY source ORDER BY doc_id) - 1)::BIGINT AS run FROM ({_RUNS})) GROUP BY ALL")
def folder_runs(spark, sf_dir):
    rows = R.consecutive(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), ["source"], ["doc_id"], "lang")
    return rows.groupBy("source", "run", "lang").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("folder_groups", "SELECT regexp_replace(url, '/?[^/]*$', '') AS folder, count(*) AS n, min(url) AS first_url FROM pages GROUP BY 1")
def folder_groups(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(T.parent(F.col("url")).alias("folder")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("first_url"))


@query("distinct_first", "SELECT lang, source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def distinct_first(spark, sf_dir):
    return R.first_by(table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], F.col("doc_id"))


@query("natural_order", r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(regexp_replace(lower(url), '(^|[^0-9])0+([0-9])', '\1\2', 'g'), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(x)::VARCHAR, 10, '0') || x ELSE x END), '') AS sort_key FROM pages""")
def natural_order(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.natural_key(F.col("url")).alias("sort_key"))


@query("topics_in_order", "SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]+)', 1) ORDER BY (url NOT LIKE '%page=2%'), page_id)::INT AS place FROM pages WHERE regexp_matches(lower(url), 'html?$|page=')")
def topics_in_order(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy(F.regexp_extract("url", "//([^/]+)", 1)).orderBy(~F.col("url").contains("page=2"), "page_id")
    return table(spark, sf_dir, "pages").where(F.lower("url").rlike("html?$|page=")).select("page_id", F.row_number().over(order).alias("place"))


@query("truncated_text", "SELECT doc_id, length(left(text, 500))::BIGINT AS n, left(text, 500) AS shown, length(text) > 500 AS cut FROM documents")
def truncated_text(spark, sf_dir):
    shown = F.left("text", F.lit(500))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(shown).cast("long").alias("n"), shown.alias("shown"), (F.length("text") > 500).alias("cut"))


@query("format_counters", "SELECT lang, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_bytes, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents GROUP BY lang")
def format_counters(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum(F.size(T.lines(F.col("text")))).cast("long").alias("n_lines"))


def _paragraphs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", r"\. |\n")).alias("idx", "label"))
    label = F.trim(F.lower("label"))
    label = F.when((F.col("idx") % 7 == 3) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("chapter "), F.col("idx").cast("string"), F.lit(" x"))).otherwise(label)
    section = F.floor(F.col("idx") / 6).cast("long")
    return rows.select("doc_id", F.col("idx").cast("long").alias("idx"), label.alias("label"), section.alias("section"), (1 + section % 4).cast("int").alias("depth"), (section * 6).alias("section_first"), F.lit(6).alias("section_size"), (F.length("label") % 5 == 0).alias("bold"))


@query("guessed_level", "SELECT doc_id, idx, CASE WHEN length(l) BETWEEN 3 AND 80 AND NOT regexp_matches(l, '[.,;]$') AND NOT contains(l, 'http') AND NOT contains(l, '@') THEN CASE WHEN regexp_matches(l, '^(part|teil)\\s+([ivxlc]+|[0-9]+)\\b') THEN 1 WHEN regexp_matches(l, '^(chapter|kapitel)\\s+[0-9ivxlc]+[.:)]?\\s*\\S') THEN 2 WHEN regexp_matches(l, '^(appendix|preface|notes|index)(\\s|$)') AND NOT regexp_matches(l, '^(notes|index)\\s*[0-9]*$|^appendix\\s+[0-9]+$') THEN 2 END END AS level FROM (SELECT doc_id, p AS idx, CASE p % 5 WHEN 0 THEN 'part ' || p || ' a' WHEN 1 THEN 'chapter ' || p || ': b' WHEN 2 THEN 'appendix ' || CASE WHEN doc_id % 2 = 0 THEN 'c' ELSE '9' END WHEN 3 THEN 'notes' ELSE left(lower(text), 20) END AS l FROM documents, range(0, 5) t(p))")
def guessed_level(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("idx"))
    n = F.col("idx").cast("string")
    label = F.when(F.col("idx") == 0, F.concat(F.lit("part "), n, F.lit(" a"))).when(F.col("idx") == 1, F.concat(F.lit("chapter "), n, F.lit(": b"))).when(F.col("idx") == 2, F.concat(F.lit("appendix "), F.when(F.col("doc_id") % 2 == 0, "c").otherwise("9"))).when(F.col("idx") == 3, "notes").otherwise(F.left(F.lower("text"), F.lit(20)))
    return rows.select("doc_id", "idx", T.guessed_level(label).alias("level"))


def like_sql(label: str, limit: int) -> str:
    return f"(length({label}) BETWEEN 3 AND {limit} AND NOT regexp_matches({label}, '[.,;]$') AND NOT contains({label}, 'http') AND NOT contains({label}, '@') AND NOT contains({label}, '://') AND NOT regexp_matches({label}, '{T.RUNNING[0]}') AND NOT regexp_matches({label}, '{T.RUNNING[1]}'))"


_LEVEL = f"CASE WHEN NOT {like_sql('label', 80)} THEN NULL " + " ".join(f"WHEN regexp_matches(label, '{pattern}') THEN {level}" for pattern, level in T.LEVELS) + " END"
_FIRST = "row_number() OVER (PARTITION BY doc_id, label ORDER BY idx) = 1"


@query("promoted_contents", rf"""
WITH s AS (SELECT doc_id, regexp_split_to_array(text, '\. |\n') AS a FROM documents),
x AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS idx FROM s),
p AS MATERIALIZED (SELECT doc_id, idx, CASE WHEN idx % 7 = 3 AND doc_id % 2 = 0 THEN 'chapter ' || idx || ' x' ELSE trim(lower(raw)) END AS label, idx // 6 AS section, length(raw) % 5 = 0 AS bold FROM x),
q AS MATERIALIZED (SELECT *, {_LEVEL} AS level, doc_id || '/' || section IN (SELECT doc_id || '/' || section FROM p WHERE idx = section * 6 AND label IN ({", ".join(f"'{c}'" for c in T.CONTENTS)})) AS listed FROM p WHERE label <> ''),
t1 AS MATERIALIZED (SELECT doc_id, idx, label, 1 AS tier, least(1 + section % 4, 3) AS level FROM q WHERE idx = section * 6 AND {like_sql('label', 140)} QUALIFY {_FIRST}),
n1 AS (SELECT doc_id, count(*) AS n FROM t1 GROUP BY doc_id),
spare AS MATERIALIZED (SELECT q.* FROM q LEFT JOIN n1 USING (doc_id) WHERE NOT (listed AND coalesce(n, 0) >= 3) AND (doc_id, label) NOT IN (SELECT doc_id, label FROM t1)),
t2 AS MATERIALIZED (SELECT doc_id, idx, label, 2 AS tier, level FROM spare WHERE level IS NOT NULL QUALIFY {_FIRST}),
n2 AS (SELECT doc_id, count(*) AS n FROM t2 GROUP BY doc_id),
t3 AS (SELECT doc_id, idx, label, 3 AS tier, 2 AS level FROM spare LEFT JOIN n2 USING (doc_id) WHERE bold AND coalesce(n, 0) < 3 AND (doc_id, label) NOT IN (SELECT doc_id, label FROM t2) QUALIFY {_FIRST})
SELECT doc_id, idx::BIGINT AS idx, label, tier::INT AS tier, level::INT AS level FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)""")
def promoted_contents(spark, sf_dir):
    return G.promoted(_paragraphs(spark, sf_dir), ["doc_id"])


@query("section_paragraphs", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, (i // 4)::BIGINT AS section, count(*) AS paragraphs, md5(arg_min(t, i)) AS first_md5 FROM p WHERE t <> '' GROUP BY ALL""")
def section_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "t")).where("t <> ''")
    return rows.groupBy("doc_id", F.expr("cast(i div 4 as bigint)").alias("section")).agg(F.count(F.lit(1)).alias("paragraphs"), F.md5(F.min_by("t", "i")).alias("first_md5"))


def _built(spark, sf_dir):
    """A conversation as a book: a turn is a section with a heading and a link to the next."""
    from ..operators.build import build

    turns = table(spark, sf_dir, "conversations")
    path = lambda n: F.concat(F.lit("t/"), n.cast("string"), F.lit(".html"))
    html = F.concat(F.lit("<body><h"), (1 + F.col("turn") % 3).cast("string"), F.lit(' id="k">'), F.col("role"), F.lit("</h"), (1 + F.col("turn") % 3).cast("string"), F.lit('><a href="'), (F.col("turn") + 1).cast("string"), F.lit('.html#k">x</a></body>'))
    sections = turns.select(F.col("conv_id").alias("book"), F.col("turn").cast("int").alias("section_idx"), path(F.col("turn")).alias("path"), html.alias("html"))
    declared = turns.where("turn = 0 AND conv_id % 2 = 0").select(F.col("conv_id").alias("book"), F.lit(0).alias("entry_idx"), F.lit(None).cast("int").alias("parent_idx"), F.lit("Start").alias("title"), path(F.col("turn")).alias("section_path"), F.lit("k").alias("fragment"))
    fallback = turns.select(F.col("conv_id").alias("book"), (F.col("conv_id") % 4 == 0).alias("is_fallback")).distinct()
    return build(sections, declared, fallback)


@query("build_contents", """WITH s AS (SELECT conv_id AS book, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, 1 + turn % 3 AS level, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT book, k::BIGINT AS entry_idx, (SELECT max(p.k) FROM s p WHERE p.book = s.book AND p.k < s.k AND p.level < s.level)::BIGINT AS parent_idx, role AS title, '#ch' || turn || '--k' AS href FROM s WHERE book % 2 = 1 OR (book % 4 = 0 AND n > 1)
UNION ALL SELECT book, 0, NULL, 'Start', '#ch0--k' FROM s WHERE turn = 0 AND book % 2 = 0 AND NOT (book % 4 = 0 AND n > 1)""")
def build_contents(spark, sf_dir):
    return _built(spark, sf_dir).contents


@query("build_links", """SELECT c.conv_id AS book, c.turn::INT AS section_idx, (c.turn + 1) || '.html#k' AS raw, CASE WHEN n.turn IS NOT NULL THEN '#ch' || n.turn || '--k' END AS target
FROM conversations c LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def build_links(spark, sf_dir):
    return _built(spark, sf_dir).links.select("book", "section_idx", "raw", "target")
