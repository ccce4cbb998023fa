"""Operator 6, licence scans: sparse TF-IDF cosine of headers and licence files to templates, nearest-ancestor inheritance.

A line is a licence line if it names a licence, a copyright or a permission, or if most of its distinct tokens
(VOCABULARY_SHARE percent, LEAST_TOKENS at least) are words of the templates. A file's blocks are its runs of licence
lines, blank lines between them left out, that hold a line of the first kind: so a header is one block wherever it
stands and however it wraps, and a licence file is one block as a whole. Each distinct block becomes a sparse vector of
its tokens, weighted by term count times ln((1 + blocks) / (1 + blocks with the token)) + 1 over all blocks of all
files, and is compared with the templates (notices, standard headers, and full texts of the short licences) by joining
on tokens. A block has the licence of its best template, if the cosine reaches min_cosine; a file's own licence is that
of its best block, and found_licenses lists those of all its blocks.

A file named like a licence, or one of whose words its licensed blocks hold at least file_share percent, speaks for its
directory. Files without a licence of their own inherit from the nearest directory above them that has one: each file
meets the directories on its path in one join, and the longest that matched is kept.

DataFrame functions only. Distinct blocks are scored once, however often they occur. The templates are constants of this
module, so their side of the token join is bounded; directories may be many and are joined without a forced broadcast.

Defined cases: null and empty texts have no licence of their own but may inherit; a null source or language is named
"unknown"; a null doc_id has the base name "unknown"; ties of cosine go to the licence's name, and of a directory's
files to the path; repeated rows give repeated results; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerloom.llm.common import table, written

MIN_COSINE, FILE_SHARE = 0.55, 50
VOCABULARY_SHARE, LEAST_TOKENS = 70, 4
#: Parts of words that make a line a licence line.
MARKS = ("licen", "copyright", "rights reserved", "spdx", "permission is hereby", "public domain", "without warranty")
_AS_IS = 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.'
_BSD_END = 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.'
_BSD_BEGIN = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU_END = "This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
#: Notices by which files name their licence, standard headers, and full texts.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", (_GNU + _GNU_END).format("Affero General Public License", 3)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD_BEGIN} {_BSD_END}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", f"{_BSD_BEGIN} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 Universal dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", (_GNU + _GNU_END).format("General Public License", 2)),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", (_GNU + _GNU_END).format("General Public License", 3)),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."),
    ("LGPL-2.1", (_GNU + _GNU_END).format("Lesser General Public License", 2.1)),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", (_GNU + _GNU_END).format("Lesser General Public License", 3)),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", f"MIT License. Copyright. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Unauthorised copying is prohibited."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided as is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; altered source versions must be plainly marked as such; this notice may not be removed or altered from any source distribution."),
)
_TOKENS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
_VALUES = ",\n    ".join(f"({n}, '{licence}', '{text.lower()}')" for n, (licence, text) in enumerate(TEMPLATES))
#: The templates' words: bounded by the templates.
VOCABULARY = sorted({t for _, text in TEMPLATES for t in re.findall(_TOKENS, text.lower())})
_WORDS = ", ".join(f"'{w}'" for w in VOCABULARY)
_NAMED = r"^(licen[cs]e|copying|notice)([._-].*)?$"


def licence_blocks(files: DataFrame) -> DataFrame:
    """(path, file_words, block, block_words, line): the licence blocks (line, and its hash) of every file, a row for each."""

    def marked(x: str) -> str:
        return "(" + " or ".join(f"contains({x}, '{m}')" for m in MARKS) + ")"

    rows = files.selectExpr("path", "text", "lower(text) as low").where(marked("low"))
    rows = rows.selectExpr("path", r"size(filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')) as file_words", r"filter(transform(split(low, '\n'), l -> trim(regexp_replace(l, '[\\x20\\x09-\\x0D]+', ' '))), l -> l <> '') as lines")
    tokens = f"array_distinct(regexp_extract_all(l, '{_TOKENS}', 0))"
    of_licences = f"(size({tokens}) >= {LEAST_TOKENS} and 100 * size(array_intersect({tokens}, array({_WORDS}))) >= {VOCABULARY_SHARE} * size({tokens}))"
    runs = f"split(array_join(transform(lines, l -> case when {marked('l')} or {of_licences} then l else '\\n' end), ' '), '\\n')"
    blocks = rows.selectExpr("path", "file_words", f"explode(filter(transform({runs}, b -> trim(b)), b -> {marked('b')})) as line")
    return blocks.selectExpr("path", "file_words", "md5(line) as block", "length(line) - length(replace(line, ' ', '')) + 1 as block_words", "line")


def line_licences(lines: DataFrame, min_cosine: float) -> DataFrame:
    """(block, licence, cosine) of each distinct block that reaches the cosine; its tokens carry its hash, not its text."""
    spark = lines.sparkSession
    distinct = written(lines.groupBy("block").agg(F.count("*").alias("n"), F.min("line").alias("line")).selectExpr("block", "n", f"regexp_extract_all(line, '{_TOKENS}', 0) as terms"), "licence-lines")
    frequency = distinct.selectExpr("explode(array_distinct(terms)) as term", "n").groupBy("term").agg(F.sum("n").alias("df"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    idf = written(frequency.crossJoin(total).selectExpr("term", "ln((1 + total) / (1 + df)) + 1 as idf", "total"), "licence-terms")
    whole = idf.agg(F.coalesce(F.max("total"), F.lit(0)).alias("whole"))
    counts = distinct.selectExpr("block", "explode(terms) as term").groupBy("block", "term").agg(F.count("*").alias("tf"))
    weights = written(counts.join(idf, "term").selectExpr("block", "term", "tf * idf as w"), "licence-weights")
    templates = spark.sql(f"SELECT * FROM VALUES {_VALUES} AS t(template, licence, text)")
    wanted = templates.selectExpr("template", "licence", f"explode(regexp_extract_all(text, '{_TOKENS}', 0)) as term").groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    wanted = wanted.join(idf, "term", "left").crossJoin(whole).selectExpr("template", "licence", "term", "tf * coalesce(idf, ln(1 + whole) + 1) as t")
    norms = wanted.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_norm"))
    lengths = weights.groupBy("block").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("w_norm"))
    dots = weights.join(F.broadcast(wanted), "term").groupBy("block", "template", "licence").agg(F.sum(F.col("w") * F.col("t")).alias("dot"))  # the templates are constants
    scored = dots.join(lengths, "block").join(F.broadcast(norms), "template").selectExpr("block", "licence", "round(dot / (w_norm * t_norm), 6) as cosine").where(f"cosine >= {min_cosine}")
    best = scored.groupBy("block").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("x"))
    return best.selectExpr("block", "x.licence as licence", "-x.c as cosine")


def license_scan(files: DataFrame, min_cosine: float = MIN_COSINE, file_share: int = FILE_SHARE) -> DataFrame:
    """(path, own_license, cosine, license, inherited_from, found_licenses) of every file (path, text)."""
    lines = written(licence_blocks(files), "licence-occurrences")
    licensed = written(line_licences(lines, min_cosine), "line-licences")
    found = lines.join(licensed, "block").select("path", "file_words", "block_words", "licence", "cosine")
    own = found.groupBy("path").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("x"), F.max("file_words").alias("file_words"), F.sum("block_words").alias("words"), F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("found_licenses"))
    own = written(own.selectExpr("path as own_path", "x.licence as own_license", "-x.c as cosine", "file_words", "words", "found_licenses"), "own-licences")
    speaks = own.where(f"lower(element_at(split(own_path, '/'), -1)) rlike '{_NAMED}' or 100 * words >= {file_share} * file_words")
    folders = speaks.selectExpr("regexp_replace(own_path, '/[^/]*$', '') as folder", "own_license as folder_license", "own_path", "cosine as c")
    folders = written(folders.groupBy("folder").agg(F.min(F.struct((-F.col("c")).alias("c"), "own_path", "folder_license")).alias("x")).selectExpr("folder", "x.folder_license as folder_license"), "licensed-folders")
    known = files.select("path").join(own.select("own_path", "own_license", "cosine", "found_licenses"), F.col("path") == F.col("own_path"), "left").select("path", "own_license", "cosine", "found_licenses")
    orphans = known.where("own_license is null").select("path").distinct()
    above = orphans.selectExpr("path", "split(path, '/') as parts").selectExpr("path", "explode(transform(sequence(1, size(parts) - 1), k -> array_join(slice(parts, 1, k), '/'))) as folder")
    heirs = above.join(folders, "folder").groupBy("path").agg(F.max(F.struct(F.length("folder").alias("n"), "folder", "folder_license")).alias("x")).selectExpr("path as heir", "x.folder as folder", "x.folder_license as folder_license")
    joined = known.join(heirs, F.expr("path = heir and own_license is null"), "left")
    return joined.select("path", "own_license", "cosine", F.coalesce("own_license", "folder_license").alias("license"), F.col("folder").alias("inherited_from"), "found_licenses")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: the directory is source, then language; the base name is the doc_id."""
    docs = table(spark, sf_dir, "documents")
    files = docs.selectExpr("concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), coalesce(cast(doc_id as string), 'unknown')) as path", "text")
    return license_scan(files).withColumn("doc_id", F.expr("try_cast(element_at(split(path, '/'), -1) as bigint)"))


def _marked(x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{m}')" for m in MARKS) + ")"


QUERIES = {"op6_license_scan": op6_license_scan}
SQL = {
    "op6_license_scan": rf"""
WITH t(template, licence, text) AS (VALUES
    {_VALUES}),
f AS (
  SELECT concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), coalesce(CAST(doc_id AS VARCHAR), 'unknown')) AS path, text FROM documents),
n AS (
  SELECT path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS file_words,
    list_filter(list_transform(string_split(lower(text), chr(10)), lambda l: trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda l: l <> '') AS lines
  FROM f WHERE {_marked("lower(text)")}),
r AS (
  SELECT path, file_words, unnest(string_split(array_to_string(list_transform(lines, lambda l: CASE WHEN {_marked("l")}
    OR (len(list_distinct(regexp_extract_all(l, '{_TOKENS}'))) >= {LEAST_TOKENS} AND 100 * len(list_filter(list_distinct(regexp_extract_all(l, '{_TOKENS}')), lambda w: list_contains([{_WORDS}], w))) >= {VOCABULARY_SHARE} * len(list_distinct(regexp_extract_all(l, '{_TOKENS}'))))
    THEN l ELSE chr(10) END), ' '), chr(10))) AS b
  FROM n),
l AS (SELECT path, file_words, trim(b) AS line FROM r WHERE {_marked("b")}),
dl AS (SELECT line, count(*) AS n, regexp_extract_all(line, '{_TOKENS}') AS terms FROM l GROUP BY line),
tot AS (SELECT coalesce(sum(n), 0) AS total FROM dl),
idf AS (
  SELECT term, ln((1 + (SELECT total FROM tot)) / (1 + sum(n))) + 1 AS idf
  FROM (SELECT unnest(list_distinct(terms)) AS term, n FROM dl) GROUP BY term),
w AS (
  SELECT line, term, count(*) * any_value(idf) AS w FROM (SELECT line, unnest(terms) AS term FROM dl) JOIN idf USING (term) GROUP BY line, term),
q AS (
  SELECT template, licence, term, count(*) * coalesce(any_value(idf), ln(1 + (SELECT total FROM tot)) + 1) AS t
  FROM (SELECT template, licence, unnest(regexp_extract_all(text, '{_TOKENS}')) AS term FROM t) LEFT JOIN idf USING (term) GROUP BY template, licence, term),
sc AS (
  SELECT w.line, q.licence, round(sum(w.w * q.t) / (any_value(wn.n) * any_value(qn.n)), 6) AS cosine
  FROM w JOIN q USING (term) JOIN (SELECT line, sqrt(sum(w * w)) AS n FROM w GROUP BY line) wn ON wn.line = w.line
  JOIN (SELECT template, sqrt(sum(t * t)) AS n FROM q GROUP BY template) qn ON qn.template = q.template
  GROUP BY w.line, q.template, q.licence),
ll AS (
  SELECT line, licence, cosine FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY cosine DESC, licence) AS r FROM sc WHERE cosine >= {MIN_COSINE}) WHERE r = 1),
own AS (
  SELECT path, first(licence ORDER BY cosine DESC, licence) AS own_license, max(cosine) AS cosine, max(file_words) AS file_words, sum(len(string_split(line, ' '))) AS words, array_to_string(list_sort(list(DISTINCT licence)), ',') AS found_licenses
  FROM l JOIN ll USING (line) GROUP BY path),
folders AS (
  SELECT folder, first(own_license ORDER BY cosine DESC, path) AS folder_license
  FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS folder, * FROM own WHERE regexp_matches(lower(string_split(path, '/')[-1]), '{_NAMED}') OR 100 * words >= {FILE_SHARE} * file_words)
  GROUP BY folder),
heirs AS (
  SELECT path, folder, folder_license FROM (
    SELECT a.path, g.folder, g.folder_license, row_number() OVER (PARTITION BY a.path ORDER BY length(g.folder) DESC) AS r
    FROM (SELECT DISTINCT path FROM f ANTI JOIN own USING (path)) a JOIN folders g ON starts_with(a.path, g.folder || '/')) WHERE r = 1)
SELECT TRY_CAST(string_split(f.path, '/')[-1] AS BIGINT) AS doc_id, f.path, own.own_license, own.cosine, coalesce(own.own_license, heirs.folder_license) AS license, heirs.folder AS inherited_from, own.found_licenses
FROM f LEFT JOIN own USING (path) LEFT JOIN heirs USING (path)
"""
}
