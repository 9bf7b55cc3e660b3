"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest ancestor directory."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged, table, text_of

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see https://www.gnu.org/licenses/."
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: The notice that reserves everything; any licence in the same text goes before it.
RESERVED = "LicenseRef-All-Rights-Reserved"
# SPDX ids, short notices, headers and texts of each licence; the texts are those that their stewards publish.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-Clause license."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-Clause license."),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released under the CC0 1.0 Universal Public Domain Dedication license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU.format("General Public License", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format("General Public License", 3)),
    ("ISC", "Released under the ISC License."),
    ("ISC", _ISC),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", 3)),
    (RESERVED, "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", _MPL),
    ("Unlicense", "This is free and unencumbered software released into the public domain. License: Unlicense."),
    ("Unlicense", _UNLICENSE),
]
TOKEN = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]*[A-Za-z0-9+])"
#: The least cosine of a notice to a template.
LEAST = 0.75
#: A word in fewer files than this share weighs no more, so scores are alike at every table size.
RARE = 0.001
#: A file whose notice has this share of its words is a licence file of its directory.
FILE_SHARE = 0.5


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _blocks(text: Column) -> Column:
    """Lines, paragraphs and the whole of a text."""
    return F.concat(F.split(text, "\n", -1), F.split(text, r"\n[ \t\r]*\n", -1), F.array(text))


def telling(units: list[dict[str, float]], rarity: dict[str, float], least: float) -> list[str]:
    """Words of which every vector with a cosine of `least` to some template holds one.

    What a template has besides its rarest words is too short for that cosine alone.
    """
    out = set()
    for unit in units:
        left = sum(x * x for x in unit.values())
        for w, x in sorted(unit.items(), key=lambda p: (-rarity[p[0]], -p[1], p[0])):
            if left < least * least * 0.999999:
                break
            out.add(w)
            left -= x * x
    return sorted(out)


def license_scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, share: float = FILE_SHARE) -> DataFrame:
    """One row per input row: id, license, score, origin ("own", "inherited" or null), from_dir.

    Lines, paragraphs (blank lines part them) and whole texts are compared with every template:
    each has a coordinate for each word of the templates and one for all other words, and the inverse
    document frequencies of the words count all files, whole texts. The best one of a file counts: a
    licence before a mere reservation of rights, then the highest cosine (to 6 digits), then the
    template that comes first. An SPDX identifier of a known licence counts as a cosine of 1. A file
    whose best notice has `share` of its words is a licence file; other files without a notice
    inherit the licence of the nearest directory above them, their own first, that has a licence
    file; of several the best one by score, then name. Null paths are in the root directory; null and
    empty texts have no notice of their own; a text of any length is read whole. Repeated rows get a
    row each. An empty table gives no row. Other columns of files are ignored.

    The driver gets one count for each word of the templates. Only texts that hold a telling word
    are compared; no other can reach the least cosine. Directories are folded before they are joined
    with the licences above them.
    """
    terms = [(name, Counter(found)) for name, text in templates if (found := _tokens(text))]
    ids = [name for name, _ in terms]
    vocabulary = sorted({w for _, t in terms for w in t})
    known = F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>")
    rows = files.select(F.col(id_col).alias("_id"), F.coalesce(path, F.lit("")).alias("_path"), text_of(text_col).alias("_text"))
    seen = {r[0]: r[1] for r in rows.select(F.explode(F.concat(F.array_intersect(_words(F.col("_text")), known), F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()}
    n = max(1, seen.get("", 0))
    idf = {w: 1 - math.log(max(seen.get(w, 0) / n, RARE)) for w in vocabulary}
    unit = []
    for _, t in terms:
        size = math.sqrt(sum((c * idf[w]) ** 2 for w, c in t.items()))
        unit.append({w: c * idf[w] / size for w, c in t.items()})
    gate = F.array(*[F.lit(w) for w in telling(unit, idf, least)]).cast("array<string>")

    spark = files.sparkSession
    # a row for each word of each template: a fixed number
    vectors = F.broadcast(spark.createDataFrame([(w, k, x * idf[w]) for k, u in enumerate(unit) for w, x in u.items()], "w string, k int, x double"))
    heavy = F.broadcast(spark.createDataFrame(list(idf.items()), "w string, idf double"))
    names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "k int, name string"))

    key = F.unhex(F.md5("_text"))
    texts = rows.select(key.alias("h"), F.col("_text").alias("text"), _words(F.col("_text")).alias("all")).where(F.arrays_overlap("all", gate))
    blocks = texts.select("h", F.size("all").alias("n_all"), F.monotonically_increasing_id().alias("r"), F.posexplode(F.array_distinct(_blocks(F.col("text")))).alias("u", "block"))
    blocks = blocks.withColumn("words", _words(F.col("block"))).where(F.arrays_overlap("words", gate)).select("r", "h", "n_all", "u", F.size("words").alias("n_words"), F.explode("words").alias("w"))
    counted = staged(blocks.join(heavy, "w").groupBy("r", "u", "h", "n_all", "n_words", "w", "idf").agg(F.count(F.lit(1)).alias("c")), "notice-words")
    own = counted.groupBy("r", "u", "h", "n_all", "n_words").agg((F.col("n_words") - F.sum("c")).cast("double").alias("others"), F.sum(F.pow(F.col("c") * F.col("idf"), F.lit(2.0))).alias("square"))
    dots = counted.join(vectors, "w").groupBy("r", "u", "k").agg(F.sum(F.col("c") * F.col("x")).alias("dot"))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("others") * F.col("others") + F.col("square")), 6)
    scored = dots.join(own, ["r", "u"]).join(names, "k").withColumn("score", cosine).where(F.col("score") >= least)
    best = scored.groupBy("h", "n_all").agg(F.min(F.struct((F.col("name") == RESERVED).alias("late"), (-F.col("score")).alias("minus"), "k", (-F.col("n_words")).alias("fewer"), "name")).alias("b"))
    best = staged(best.select("h", F.col("b.name").alias("license"), (-F.col("b.minus")).alias("score"), (-F.col("b.fewer") >= share * F.col("n_all")).alias("is_file")), "notices")
    said = F.when(F.col("_text").rlike("(?i)spdx-license-identifier"), F.regexp_extract("_text", SPDX, 1))
    said = F.when(said.isin(*ids), F.struct(said.alias("name"), (F.size(_words(F.regexp_extract("_text", SPDX, 0))) >= share * F.size(_words(F.col("_text")))).alias("is_file")))
    mine = rows.select("_id", F.regexp_replace("_path", "/?[^/]*$", "").alias("dir"), key.alias("h"), said.alias("said")).join(best, "h", "left")
    score = F.when(F.col("said").isNotNull(), F.lit(1.0)).otherwise(F.col("score"))
    found = staged(mine.select("_id", "dir", F.coalesce("said.name", "license").alias("license"), score.alias("score"), F.coalesce("said.is_file", "is_file", F.lit(False)).alias("is_file")), "files")
    grants = found.where("is_file").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("g")).select(F.col("dir").alias("above"), F.col("g.license").alias("license"), (-F.col("g.minus")).alias("score"))
    grants = staged(grants, "grants")
    parts = F.split("dir", "/")
    dirs = found.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.struct(F.lit("").alias("above"), F.lit(0).alias("depth")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("above"), d.alias("depth")))
    )).alias("a")).select("dir", "a.above", "a.depth")
    near = dirs.join(grants, "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "license", "score")).alias("near"))
    near = staged(near, "near")
    own = F.col("license").isNotNull()
    return found.join(near, "dir", "left").select(
        F.col("_id").alias(id_col),
        F.coalesce("license", "near.license").alias("license"),
        F.coalesce("score", "near.score").alias("score"),
        F.when(own, "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(own, F.col("dir")).otherwise(F.col("near.above")).alias("from_dir"),
    )


def _tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def document_path() -> Column:
    """documents have no path: a source is a directory, with one below it for each thousand ids."""
    return F.concat_ws("/", F.coalesce("source", F.lit("")), F.expr("doc_id div 1000").cast("string"), F.col("doc_id").cast("string"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), "doc_id", document_path())


_T = ", ".join(f"({k}, '{name}', '{w}', {c})" for k, (name, text) in enumerate(TEMPLATES) for w, c in Counter(_tokens(text)).items())
SQL = f"""
WITH t(k, name, w, c) AS (VALUES {_T}),
v AS MATERIALIZED (SELECT DISTINCT w FROM t),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', coalesce(source, ''), (doc_id // 1000)::VARCHAR) AS dir, coalesce(text, '') AS text, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}')) AS ws FROM documents),
idf AS MATERIALIZED (SELECT w, 1 - ln(greatest(coalesce(n, 0) / (SELECT count(*) FROM d), {RARE})) AS i FROM v LEFT JOIN (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM d) JOIN v USING (w) GROUP BY w) USING (w)),
size AS MATERIALIZED (SELECT k, sqrt(sum((c * i) * (c * i))) AS s FROM t JOIN idf USING (w) GROUP BY k),
l AS MATERIALIZED (SELECT r, row_number() OVER () AS q, regexp_extract_all(lower(block), '{TOKEN}') AS ws FROM (SELECT r, unnest(string_split(text, chr(10)) || string_split_regex(text, '\n[ \t\r]*\n') || [text]) AS block FROM d)),
lw AS MATERIALIZED (SELECT r, q, w, count(*) AS c FROM (SELECT r, q, unnest(ws) AS w FROM l) GROUP BY r, q, w),
norm AS MATERIALIZED (SELECT q, sqrt(sum(CASE WHEN i IS NULL THEN 0 ELSE (c * i) * (c * i) END) + sum(CASE WHEN i IS NULL THEN c ELSE 0 END) * sum(CASE WHEN i IS NULL THEN c ELSE 0 END)) AS s, sum(c) AS words FROM lw LEFT JOIN idf USING (w) GROUP BY q),
every AS (
  SELECT lw.r, t.k, t.name, any_value(norm.words) AS words, round(sum(lw.c * t.c * i * i) / any_value(norm.s) / any_value(size.s), 6) AS score
  FROM lw JOIN t USING (w) JOIN idf USING (w) JOIN norm USING (q) JOIN size USING (k) GROUP BY lw.r, lw.q, t.k, t.name
  UNION ALL SELECT r, -1, regexp_extract(text, '{SPDX}', 1), len(regexp_extract_all(lower(regexp_extract(text, '{SPDX}', 0)), '{TOKEN}')), 1.0 FROM d WHERE regexp_extract(text, '{SPDX}', 1) IN (SELECT name FROM t)),
best AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY name = '{RESERVED}', score DESC, k, words DESC) AS o FROM every WHERE score >= {LEAST}) WHERE o = 1),
f AS MATERIALIZED (
  SELECT d.r, doc_id, dir, name AS license, score, coalesce(words >= {FILE_SHARE} * len(regexp_extract_all(lower(text), '{TOKEN}')), false) AS is_file FROM d LEFT JOIN best ON d.r = best.r),
g AS MATERIALIZED (SELECT dir, license, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) AS o FROM f WHERE is_file) WHERE o = 1),
a AS (SELECT DISTINCT f.dir, list_aggregate(string_split(f.dir, '/')[1:x], 'string_agg', '/') AS above, x FROM f, range(0, 3) z(x)),
near AS (SELECT * FROM (SELECT a.dir, g.dir AS above, g.license, g.score, row_number() OVER (PARTITION BY a.dir ORDER BY x DESC) AS o FROM a JOIN g ON coalesce(a.above, '') = g.dir) WHERE o = 1)
SELECT doc_id, coalesce(f.license, near.license) AS license, coalesce(f.score, near.score) AS score,
       CASE WHEN f.license IS NOT NULL THEN 'own' WHEN near.license IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN f.license IS NOT NULL THEN f.dir ELSE near.above END AS from_dir
FROM f LEFT JOIN near ON f.dir = near.dir
"""
