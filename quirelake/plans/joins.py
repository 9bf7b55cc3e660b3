"""Links and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import links as L
from .catalog import query, table

_LINKS = r"""SELECT page_id, url, (generate_subscripts(m, 1) - 1)::BIGINT AS link_idx, unnest(m) AS m FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)\b(?:src|href|poster)="[^"]+"') AS m FROM pages)"""
_RAW = r"replace(regexp_extract(m, '(?s)=\"([^\"]+)\"', 1), '&amp;', '&')"


@query("links", rf"SELECT page_id, link_idx, lower(regexp_extract(m, '^(\w+)', 1)) AS attr, {_RAW} AS raw FROM ({_LINKS})")
def links(spark, sf_dir):
    return L.links(table(spark, sf_dir, "pages"), ["page_id"], "html")


def _references(spark, sf_dir):
    """References of several shapes, made of what the pages hold."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"//[^/]+/(.*)$", 1).alias("p"))
    k = F.col("page_id") % 8
    raw = (
        F.when(k == 0, F.concat(F.lit("../a%20b+c/"), "p"))
        .when(k == 1, F.concat(F.lit("/"), "p", F.lit("#n%C3%A9e")))
        .when(k == 2, F.concat(F.lit("./x/../../../"), "p"))
        .when(k == 3, F.concat(F.lit("%zz/"), "p"))
        .when(k == 4, F.concat(F.lit("#f"), F.col("page_id").cast("string")))
        .when(k == 5, F.col("url"))
        .when(k == 6, F.lit("mailto:a@b.example"))
        .otherwise(F.concat(F.lit("//cdn.example/"), "p"))
    )
    return pages.select("page_id", raw.alias("raw"), F.lit("OEBPS/text").alias("base"), F.when(F.col("page_id") % 3 == 0, "src").otherwise("href").alias("attr"))


_REFS = r"""SELECT page_id, 'OEBPS/text' AS base, CASE WHEN page_id % 3 = 0 THEN 'src' ELSE 'href' END AS attr, CASE page_id % 8 WHEN 0 THEN '../a%20b+c/' || p WHEN 1 THEN '/' || p || '#n%C3%A9e' WHEN 2 THEN './x/../../../' || p WHEN 3 THEN '%zz/' || p
 WHEN 4 THEN '#f' || page_id WHEN 5 THEN url WHEN 6 THEN 'mailto:a@b.example' ELSE '//cdn.example/' || p END AS raw FROM (SELECT page_id, url, regexp_extract(url, '//[^/]+/(.*)$', 1) AS p FROM pages)"""


@query("normalize_path", rf"""WITH d AS (SELECT page_id, base, regexp_extract(CASE WHEN starts_with(raw, '%zz') THEN raw ELSE url_decode(replace(raw, '+', '%2B')) END, '(?s)^([^#?]*)', 1) AS v FROM ({_REFS}))
SELECT page_id, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(CASE WHEN starts_with(v, '/') THEN v ELSE base || '/' || v END, '/'), lambda x: [x])),
  lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] ELSE list_concat(a, x) END), '/') AS path FROM d""")
def normalize_path(spark, sf_dir):
    return _references(spark, sf_dir).select("page_id", T.normalized(F.col("raw"), F.col("base")).alias("path"))


@query("split_fragment", rf"SELECT page_id, regexp_extract(raw, '(?s)^([^#]*)', 1) AS bare, CASE WHEN contains(raw, '#') THEN nullif(url_decode(regexp_extract(raw, '(?s)^[^#]*#(.*)$', 1)), '') END AS fragment FROM ({_REFS})")
def split_fragment(spark, sf_dir):
    return _references(spark, sf_dir).select("page_id", F.regexp_extract("raw", "(?s)^([^#]*)", 1).alias("bare"), T.fragment(F.col("raw")).alias("fragment"))


@query("link_class", rf"""SELECT page_id, CASE WHEN starts_with(raw, '#') THEN 'fragment' WHEN (starts_with(lower(raw), 'http:') OR starts_with(lower(raw), 'https:') OR starts_with(raw, '//')) THEN CASE attr WHEN 'href' THEN 'remote' ELSE 'blocked' END
WHEN regexp_matches(lower(raw), '^(file|data|mailto|tel|javascript|blob):') THEN 'external' ELSE 'internal' END AS class FROM ({_REFS})""")
def link_class(spark, sf_dir):
    return _references(spark, sf_dir).select("page_id", L.link_class(F.col("raw"), F.col("attr")).alias("class"))


@query("blocked_remote", rf"SELECT page_id, 'Network image blocked: ' || lower(regexp_extract(raw, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)', 1)) AS label FROM ({_REFS}) WHERE attr <> 'href' AND regexp_matches(lower(raw), '^(https?:|//)')")
def blocked_remote(spark, sf_dir):
    refs = _references(spark, sf_dir)
    return refs.where(L.link_class(F.col("raw"), F.col("attr")) == "blocked").select("page_id", L.blocked_label(F.col("raw")).alias("label"))


@query("link_hosts", "SELECT regexp_extract(url, '//([^/:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def link_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(L.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_HOSTED = r"SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, trim(regexp_extract(url, '//[^/]+(/[^?#]*)', 1), '/') AS path FROM pages"


@query("section_join", f"""WITH s AS ({_HOSTED}), f AS (SELECT host, path, min(page_id) AS first FROM s GROUP BY ALL)
SELECT s.page_id, CASE WHEN f.first IS NOT NULL THEN '#ch' || f.first || '--top' END AS target
FROM s LEFT JOIN f ON s.host = f.host AND f.path = CASE WHEN s.page_id % 2 = 0 THEN s.path ELSE s.path || '/none' END""")
def section_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("host"), F.regexp_extract("url", "//[^/]+(/[^?#]*)", 1).alias("at"))
    sections = pages.select("host", F.col("page_id").alias("section_idx"), T.normalized(F.col("at"), F.lit("")).alias("path"))
    found = pages.select("page_id", "host", F.concat("at", F.when(F.col("page_id") % 2 == 0, "").otherwise("/none"), F.lit("#top")).alias("raw"), F.lit("").alias("base"))
    return L.resolved(found, sections, ["host"]).select("page_id", "target")


_TURNS = "SELECT conv_id, turn, 'ch' || (turn + 1 + conv_id % 2) AS target FROM conversations"


@query("dangling_targets", f"SELECT t.conv_id, t.turn, CASE WHEN c.turn IS NOT NULL THEN t.target END AS target FROM ({_TURNS}) t LEFT JOIN (SELECT DISTINCT conv_id, turn FROM conversations) c ON c.conv_id = t.conv_id AND 'ch' || c.turn = t.target")
def dangling_targets(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    entries = turns.select("conv_id", "turn", F.concat(F.lit("ch"), (F.col("turn") + 1 + F.col("conv_id") % 2).cast("string")).alias("target"))
    return L.surviving(entries, turns.select("conv_id", F.concat(F.lit("ch"), F.col("turn").cast("string")).alias("anchor")), ["conv_id"], "target")


@query("anchor_fallback", "SELECT t.conv_id, t.turn, CASE WHEN t.turn % 2 = 0 AND c.turn IS NOT NULL THEN 'ch' || c.turn || '--x' ELSE 'ch' || (t.turn + 1) END AS anchor FROM conversations t LEFT JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1")
def anchor_fallback(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    href = F.concat(F.lit("#ch"), (F.col("turn") + 1).cast("string"), F.when(F.col("turn") % 2 == 0, "--x").otherwise("--y"))
    anchors = turns.select("conv_id", F.concat(F.lit("ch"), F.col("turn").cast("string"), F.lit("--x")).alias("anchor"))
    return L.with_fallback(turns.select("conv_id", "turn", href.alias("href")), anchors, ["conv_id"], "href").select("conv_id", "turn", "anchor")


@query("spine_join", "SELECT l_orderkey, l_linenumber, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS place FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size <= 10")
def spine_join(spark, sf_dir):
    spine = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    manifest = table(spark, sf_dir, "part").where("p_size <= 10").select("p_partkey", "p_name")
    joined = spine.join(manifest, spine["l_partkey"] == manifest["p_partkey"])
    return joined.select("l_orderkey", "l_linenumber", "p_name", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")).alias("place"))


_PAGES = "SELECT page_id AS page, lower(regexp_extract(url, '([^/]*)/?$', 1)) AS name FROM pages"


@query("bookmark_lookup", f"""WITH p AS ({_PAGES}), b AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN 'x/' || upper(user_id || '.html') ELSE 'none' END AS ref FROM events)
SELECT event_id, coalesce(i.page, n.page) AS page FROM b LEFT JOIN p i ON try_cast(ref AS BIGINT) = i.page LEFT JOIN (SELECT name, min(page) AS page FROM p GROUP BY name) n ON lower(regexp_extract(ref, '([^/]*)$', 1)) = n.name AND try_cast(ref AS BIGINT) IS NULL""")
def bookmark_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.lower(F.regexp_extract("url", "([^/]*)/?$", 1)).alias("name"))
    k, user = F.col("event_id") % 3, F.col("user_id").cast("string")
    ref = F.when(k == 0, user).when(k == 1, F.concat(F.lit("x/"), F.upper(F.concat(user, F.lit(".html"))))).otherwise("none")
    marks = table(spark, sf_dir, "events").select("event_id", ref.alias("ref"))
    number = F.col("ref").try_cast("bigint")
    name = F.when(number.isNull(), F.lower(F.regexp_extract("ref", "([^/]*)$", 1)))
    return L.first_key_found(marks, [(pages, "page", number, "page"), (pages, "name", name, "page")]).select("event_id", F.col("found").alias("page"))


@query("fragment_lookup", """WITH n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation), s AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN s_nationkey::VARCHAR WHEN 1 THEN (SELECT max(n_name) FROM n WHERE n.n_nationkey = s_nationkey) ELSE 'r' || s_nationkey % 5 END AS f FROM supplier)
SELECT s_suppkey, coalesce(a.n_nationkey, b.n_nationkey, c.k)::INT AS page FROM s LEFT JOIN n a ON try_cast(f AS BIGINT) = a.n_nationkey LEFT JOIN n b ON f = b.n_name LEFT JOIN (SELECT 'r' || n_regionkey AS t, min(n_nationkey) AS k FROM n GROUP BY 1) c ON f = c.t""")
def fragment_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("title", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    supplier = table(spark, sf_dir, "supplier")
    named = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select("s_suppkey", "s_nationkey", "n_name")
    k = F.col("s_suppkey") % 3
    f = F.when(k == 0, F.col("s_nationkey").cast("string")).when(k == 1, F.col("n_name")).otherwise(F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")))
    marks = named.select("s_suppkey", f.alias("f"))
    return L.first_key_found(marks, [(nation, "n_nationkey", F.col("f").try_cast("bigint"), "n_nationkey"), (nation, "n_name", F.col("f"), "n_nationkey"), (nation, "title", F.col("f"), "n_nationkey")]).select("s_suppkey", F.col("found").alias("page"))


@query("ordinal_zip", """WITH r AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k FROM conversations)
SELECT a.conv_id, a.k::INT AS k, length(a.text)::BIGINT AS asked, length(b.text)::BIGINT AS answered FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.k = b.k AND a.role = 'user' AND b.role = 'assistant'""")
def ordinal_zip(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn")))
    a = rows.where("role = 'user'").select("conv_id", "k", F.length("text").cast("long").alias("asked"))
    b = rows.where("role = 'assistant'").select("conv_id", "k", F.length("text").cast("long").alias("answered"))
    return a.join(b, ["conv_id", "k"])


@query("parent_pointer", "SELECT c.conv_id, c.turn, p.role AS parent_role FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = (c.turn * 3) % 4 AND p.turn < c.turn")
def parent_pointer(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("turn") * 3) % 4).alias("parent"))
    p = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("parent"), F.col("role").alias("parent_role"))
    return c.withColumn("parent", F.when(F.col("parent") < F.col("turn"), F.col("parent"))).join(p, ["conv_id", "parent"], "left").select("conv_id", "turn", "parent_role")


@query("anchors_at_offset", "SELECT source, n_chars, array_to_string(list_sort(list('a' || doc_id)), ',') AS anchors FROM documents WHERE source <> 'src0' GROUP BY ALL")
def anchors_at_offset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("source <> 'src0'")
    return docs.groupBy("source", "n_chars").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("a"), F.col("doc_id").cast("string")))), ",").alias("anchors"))


@query("last_wins_union", "SELECT key, arg_max(value, prio) AS value FROM (SELECT lang AS key, min(doc_id) AS value, 0 AS prio FROM documents GROUP BY lang UNION ALL SELECT role, min(conv_id), 1 FROM conversations GROUP BY role UNION ALL SELECT 'en', 7, 2) GROUP BY key")
def last_wins_union(spark, sf_dir):
    a = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("key")).agg(F.min("doc_id").alias("value")).withColumn("prio", F.lit(0))
    b = table(spark, sf_dir, "conversations").groupBy(F.col("role").alias("key")).agg(F.min("conv_id").alias("value")).withColumn("prio", F.lit(1))
    c = spark.range(1).select(F.lit("en").alias("key"), F.lit(7).cast("long").alias("value"), F.lit(2).alias("prio"))
    return a.unionByName(b).unionByName(c).groupBy("key").agg(F.max_by("value", "prio").alias("value"))


@query("offset_anchor", "WITH a AS (SELECT n_chars AS off, min('a' || lpad(doc_id::VARCHAR, 8, '0')) AS anchor FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT d.doc_id, a.anchor FROM documents d LEFT JOIN a ON d.n_chars = a.off")
def offset_anchor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    planted = docs.where("doc_id % 3 = 0").select(F.col("n_chars").alias("off"), F.concat(F.lit("a"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("anchor"))
    return L.first_key_found(docs, [(planted, "off", F.col("n_chars"), "anchor")]).select("doc_id", F.col("found").alias("anchor"))
