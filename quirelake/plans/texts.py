"""Text functions over pages (a page is a book of one section) and documents (Markdown bodies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rules import apply, apply_sql, quoted
from ..operators import find as D
from .catalog import query, table

COLLAPSED = apply_sql("html", T.COLLAPSE)


def collapsed_sql(x: str) -> str:
    return apply_sql(x, T.COLLAPSE)


@query("extract_body", r"""
WITH b AS (SELECT page_id, html, instr(lower(html), '<body') AS s, instr(lower(html), '</body>') AS e FROM pages),
c AS (SELECT *, instr(substr(html, greatest(s, 1)), '>') + s - 1 AS g FROM b)
SELECT page_id, md5(CASE WHEN s > 0 AND e > 0 AND g >= s AND g < e THEN substr(html, g + 1, e - g - 1) ELSE html END) AS body_md5,
  CASE WHEN e > 0 THEN nullif(regexp_extract(regexp_extract(html, '(?i)<body[^>]*>', 0), 'id\s*=\s*["'']([^"'']+)["'']', 1), '') END AS body_id FROM c""")
def extract_body(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.body(F.col("html"))).alias("body_md5"), T.body_id(F.col("html")).alias("body_id"))


@query("collapsed_text", f"SELECT page_id, md5({COLLAPSED}) AS text_md5, length({COLLAPSED})::BIGINT AS n_chars FROM pages")
def collapsed_text(spark, sf_dir):
    text = T.collapsed(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@query("entity_decode", f"SELECT page_id, md5({apply_sql('html', T.ENTITIES)}) AS decoded_md5 FROM pages")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.decoded(F.col("html"))).alias("decoded_md5"))


@query("escape_html", "SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS escaped_md5 FROM documents")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.escaped(F.col("text"))).alias("escaped_md5"))


_TITLE = collapsed_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
_H1 = collapsed_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")


@query("page_title", f"SELECT page_id, coalesce(nullif({_TITLE}, ''), nullif({_H1}, '')) AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.first_text(F.col("html"), "title", "h1").alias("title"))


@query("slug", f"SELECT page_id, {apply_sql('lower(regexp_extract(html, ' + quoted('(?is)<h1[^>]*>(.*?)</h1>') + ', 1))', T.SLUG)} AS slug FROM pages")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1)).alias("slug"))


@query("strip_scaffolding", f"SELECT page_id, md5({apply_sql('html', T.SCAFFOLD)}) AS inner_md5 FROM pages")
def strip_scaffolding(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(apply(F.col("html"), T.SCAFFOLD)).alias("inner_md5"))


@query("prefix_anchors", r"""SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)([\s"'']id=")([^"]+")', '\1ch' || page_id || '--\2', 'g'),
  '(?i)([\s"'']id='')([^'']+'')', '\1ch' || page_id || '--\2', 'g'), '(?i)(href="#)([^"]+")', '\1ch' || page_id || '--\2', 'g'), '(?i)(href=''#)([^'']+'')', '\1ch' || page_id || '--\2', 'g')) AS html_md5
  FROM (SELECT page_id, replace(html, 'href="/', 'href="#') AS html FROM pages)""")
def prefix_anchors(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="#')))  # in-page links, which the pages lack
    return pages.select("page_id", F.md5(T.prefixed(F.col("html"), F.col("page_id"))).alias("html_md5"))


@query("math_spans", f"SELECT doc_id, len(regexp_extract_all(text, {quoted(T.MATH)}))::BIGINT AS n_spans, coalesce(md5(nullif(array_to_string(regexp_extract_all(text, {quoted(T.MATH)}), '|'), '')), '') AS spans_md5 FROM documents")
def math_spans(spark, sf_dir):
    spans = T.math_spans(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(spans).cast("long").alias("n_spans"), F.coalesce(F.md5(F.nullif(F.array_join(spans, "|"), F.lit(""))), F.lit("")).alias("spans_md5"))


@query("strip_mdx", r"SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^(import|export)\b')), chr(10))) AS text_md5 FROM documents")
def strip_mdx(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.when(F.col("text").rlike("(?m)^(import|export)\\b"), T.without_mdx(F.col("text"))).otherwise(F.col("text"))).alias("text_md5"))


@query("code_lines", "SELECT doc_id, len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)))::BIGINT AS n_lines, len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) > 12 AS folds, len(string_split(regexp_replace(text, chr(10) || '$', ''), chr(10))) > 3 AS resizes FROM documents")
def code_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(T.code_lines(F.col("text")))))


@query("thumbnail_card", f"""SELECT page_id, coalesce(nullif({_TITLE}, ''), regexp_extract(url, '([^/]*)$', 1)) AS title, upper(regexp_extract(url, '^(\\w+):', 1)) AS subtitle,
  left({collapsed_sql('left(html, 200000)')}, 600) AS opening FROM pages""")
def thumbnail_card(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", *T.card(T.first_text(F.col("html"), "title"), F.regexp_extract("url", "([^/]*)$", 1), F.lit(None).cast("string"), F.regexp_extract("url", r"^(\w+):", 1), F.col("html")))


@query("media_type", "SELECT page_id, CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MEDIA.items()) + " ELSE 'application/octet-stream' END AS mime FROM pages")
def media_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.media_type(F.col("url")).alias("mime"))


@query("format_dispatch", "SELECT page_id, CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.FORMATS.items()) + " END AS format FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '.EPUB' WHEN 1 THEN '.cbt' WHEN 2 THEN '.md' ELSE '' END AS url FROM pages)")
def format_dispatch(spark, sf_dir):
    ending = F.when(F.col("page_id") % 4 == 0, ".EPUB").when(F.col("page_id") % 4 == 1, ".cbt").when(F.col("page_id") % 4 == 2, ".md").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", T.book_format(F.concat("url", ending)).alias("format"))


@query("size_note", "SELECT doc_id, format('first {:.0f} MB of {:.0f} MB', round_even(strlen(text) * 300 / 1048576.0, 0), round_even(strlen(text) * 900 / 1048576.0, 0)) AS note FROM documents")
def size_note(spark, sf_dir):
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.size_note(n * 300, n * 900).alias("note"))


@query("url_encode_path", "SELECT page_id, replace(url_encode(t), '%2F', '/') AS encoded FROM (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '[^\\p{L}\\p{N} /_.-]', '', 'g') AS t FROM pages)")
def url_encode_path(spark, sf_dir):
    title = F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"[^\p{L}\p{N} /_.-]", "")
    return table(spark, sf_dir, "pages").select("page_id", T.percent_encoded(title).alias("encoded"))


@query("leading_text", "SELECT doc_id, trim(left(trim(text), 80)) AS lead FROM documents")
def leading_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.left(F.trim("text"), F.lit(80))).alias("lead"))


@query("window_title", "SELECT doc_id, concat_ws(' — ', nullif(source, 'src0'), nullif(lang, '')) AS title, coalesce(CASE WHEN doc_id % 3 = 0 THEN source ELSE source || ' #' || doc_id END, lang) AS display FROM documents")
def window_title(spark, sf_dir):
    number = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", T.window_title(F.nullif("source", F.lit("src0")), F.col("lang")).alias("title"), T.display_title(F.col("source"), number, F.col("lang")).alias("display"))


@query("tolerant_int", "SELECT event_id, CASE WHEN lower(trim(x)) IN ('true', 'yes') THEN 1 WHEN lower(trim(x)) IN ('false', 'no') THEN 0 ELSE trunc(try_cast(trim(x) AS DOUBLE))::BIGINT END AS n FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'True' WHEN 1 THEN ' no ' WHEN 2 THEN event_type ELSE value::DECIMAL(18, 2)::VARCHAR END AS x FROM events)")
def tolerant_int(spark, sf_dir):
    k = F.col("event_id") % 4
    text = F.when(k == 0, "True").when(k == 1, " no ").when(k == 2, F.col("event_type")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", T.tolerant_int(text).alias("n"))


@query("parent_path", "SELECT page_id, regexp_replace(url, '/?[^/]*$', '') AS parent FROM pages")
def parent_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.parent(F.col("url")).alias("parent"))


_NEEDLE = "'the '"


@query("find_counts", "SELECT doc_id, ((length(text) - length(replace(CASE WHEN length(lower(text)) = length(text) THEN lower(text) ELSE text END, 'an', ''))) // 2)::BIGINT AS total FROM documents")
def find_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.occurrences(F.col("text"), F.lit(" AN ")).alias("total"))


_FOUND = "SELECT doc_id, source, ((length(text) - length(replace(CASE WHEN length(lower(text)) = length(text) THEN lower(text) ELSE text END, 'e', ''))))::BIGINT AS n FROM documents"


@query("find_summary", f"SELECT doc_id, source <> 'src0' AS available, CASE WHEN source <> 'src0' THEN least(n, 1000) ELSE 0 END::BIGINT AS total, CASE WHEN source = 'src0' OR n = 0 THEN -1 ELSE doc_id % least(n, 1000) END::BIGINT AS index, source <> 'src0' AND n >= 1000 AS capped FROM ({_FOUND})")
def find_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("source") == "src0", "djvu").otherwise("epub")
    return docs.select("doc_id", *D.summary(D.occurrences(F.col("text"), F.lit("E")), T.searchable(kind), F.col("doc_id")))


@query("find_in_text_nodes", r"""WITH n AS (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', '<x>', 'g'), '<[^>]*>')) AS t FROM pages)
SELECT page_id, sum(((length(t) - length(replace(CASE WHEN length(lower(t)) = length(t) THEN lower(t) ELSE t END, 'th', ''))) // 2))::BIGINT AS total FROM n GROUP BY page_id""")
def find_in_text_nodes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.aggregate(F.transform(D.text_nodes(F.col("html")), lambda t: D.occurrences(t, F.lit("th"))), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query("settings", "SELECT event_id, coalesce(props->>'$.page', '/') AS page, coalesce(try_cast(props->>'$.zoom' AS DOUBLE), 1.0) AS zoom, coalesce(try_cast(props->>'$.images' AS BOOLEAN), false) AS images FROM events")
def settings(spark, sf_dir):
    parsed = F.from_json("props", "page string, zoom double, images boolean")
    return table(spark, sf_dir, "events").withColumn("s", parsed).select("event_id", F.coalesce("s.page", F.lit("/")).alias("page"), F.coalesce("s.zoom", F.lit(1.0)).alias("zoom"), F.coalesce("s.images", F.lit(False)).alias("images"))


@query("cut_at_heading", "SELECT page_id, CASE WHEN length(html) <= 2000 THEN html WHEN contains(lower(right(left(html, 2000), 1500)), '<h') THEN left(html, 2000 - length(list_last(string_split(lower(right(left(html, 2000), 1500)), '<h'))) - 2) ELSE left(html, 2000) END AS shown FROM pages")
def cut_at_heading(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.cut_at_heading(F.col("html"), 2000, 1500).alias("shown"))


@query("page_labels", """SELECT doc_id, CASE WHEN t <> '' AND NOT regexp_matches(lower(t), '\\.(djvu|tiff?|png)$') AND t IS DISTINCT FROM lang THEN t ELSE (doc_id + 1)::VARCHAR END AS label,
'<div class="page-frame" data-page="' || doc_id || '" data-label="' || (doc_id + 1) || '"' || CASE WHEN n_chars % 3 > 0 THEN ' style="aspect-ratio: ' || n_chars || ' / ' || n_chars % 3 || '"' ELSE '' END || '></div>' AS frame
FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN source || '.DjVu' WHEN 1 THEN '' WHEN 2 THEN lang ELSE source END AS t FROM documents)""")
def page_labels(spark, sf_dir):
    k = F.col("doc_id") % 4
    title = F.when(k == 0, F.concat("source", F.lit(".DjVu"))).when(k == 1, "").when(k == 2, F.col("lang")).otherwise(F.col("source"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.page_label(title, F.col("lang"), F.col("text"), F.col("doc_id")).alias("label"), T.page_frame(F.col("doc_id"), F.col("n_chars"), F.col("n_chars") % 3).alias("frame"))


@query("archive_pages", """SELECT page_id, path FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '__MACOSX/' WHEN 1 THEN 'a/._' WHEN 2 THEN '.' ELSE 'b/' END || page_id || CASE page_id % 4 WHEN 3 THEN '.txt' ELSE '.JPG' END AS path FROM pages) WHERE page_id % 6 > 2 AND page_id % 4 <> 3""")
def archive_pages(spark, sf_dir):
    k = F.col("page_id") % 6
    path = F.concat(F.when(k == 0, "__MACOSX/").when(k == 1, "a/._").when(k == 2, ".").otherwise("b/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 == 3, ".txt").otherwise(".JPG"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).where(~T.is_noise(F.col("path")) & T.is_picture(F.col("path")))


@query("octal_numbers", "SELECT DISTINCT p_partkey, p_size::BIGINT AS n FROM part")
def octal_numbers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.octal(F.concat(F.lit("  0"), F.conv(F.col("p_size").cast("string"), 10, 8), F.lit(" "))).alias("n")).distinct()


@query("contents_label", "SELECT doc_id, CASE WHEN lang = 'fr' THEN '目录' ELSE 'Contents' END AS label FROM documents")
def contents_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.contents_label(F.when(F.col("lang") == "fr", "zh-Hant").otherwise(F.col("lang"))).alias("label"))


@query("settings_fan_out", "SELECT page_id FROM pages WHERE page_id % 4 IN (2, 3)")
def settings_fan_out(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.concat("url", F.when(k == 0, ".epub").when(k == 1, ".djvu").when(k == 2, ".MD").otherwise(".fb2"))
    return table(spark, sf_dir, "pages").where(T.follows_settings(path)).select("page_id")
