"""License scans: Dice coefficient over word bigrams against licence templates.

Units of a document (its lines, its paragraphs of several lines, its whole text,
and windows of a template's own size anywhere in its words, whatever lines and
paragraphs they run through) are normalised to lower-case words and compared with
the normalised templates as sets of word bigrams.  A window starts at a bigram of
its template; bigrams that the template has not count once for each place in it.
Bounds prune before anything is compared:

* size: Dice >= t needs t/(2-t) * |T| <= |U| <= (2-t)/t * |T|;
* words: Dice >= t needs at least t/(2-t) * |T| shared bigrams, so a set of words
  that touches more of each template's bigrams than may be missing must be met.
  ``keywords`` derives it from the templates; texts without one are skipped whole;
* places: a window needs as many of its template's bigrams within its length.

All SQL functions.  The template table is a constant of the library, checked
against ``BROADCAST_BIGRAMS`` before it is broadcast.  Common bigrams are counted
by partial aggregation for each (document, unit, template).

Defined cases: null and empty texts and texts without a word match nothing; a
repeated row is matched as often as it stands there; of the templates that one
unit matches the one with most common bigrams counts, then the best score (all of
them in a tie), so that a licence is not taken for another that it contains; a
licence that several units match is reported with its best score (then the
shortest, first unit name); an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, text_or_empty

THRESHOLD = 0.8
BROADCAST_BIGRAMS = 200_000

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THREE = _BSD_TWO + (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_MIT_WARRANTY = (
    " The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, "
    "fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, "
    "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_ISC_WARRANTY = (
    " The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
    "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
    "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
)
_BSD_WARRANTY = (
    " This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of "
    "merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, "
    "exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused "
    "and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, "
    "even if advised of the possibility of such damage."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version {v} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
)
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."

# Licence notices as their publishers word them, full and short.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT_GRANT),
    ("MIT", _MIT_GRANT + _MIT_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", _ISC),
    ("ISC", _ISC + _ISC_WARRANTY),
    ("ISC", "Licensed under the ISC License."),
    ("BSD-2-Clause", _BSD_TWO),
    ("BSD-3-Clause", _BSD_THREE),
    ("BSD-2-Clause", _BSD_TWO + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_THREE + _BSD_WARRANTY),
    ("BSD", "Licensed under the BSD License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", _GPL.format(v=2)),
    ("GPL-3.0", _GPL.format(v=3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", _MPL),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "All rights reserved."),
)


def _words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_rows(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(template number, licence, sorted distinct bigrams)."""
    rows = []
    for i, (name, text) in enumerate(templates):
        words = _words_of(text)
        rows.append((i, name, sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})))
    return rows


def _template_entries(templates: tuple[tuple[str, str], ...]) -> list[tuple[int, str, str, int, int, int]]:
    """(template, licence, bigram, its number in the template, distinct bigrams, words) for every bigram."""
    return [(i, name, b, k, len(bs), len(_words_of(templates[i][1]))) for i, name, bs in template_rows(templates) for k, b in enumerate(bs)]


def keywords(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every text within ``threshold`` of a template must hold at least one."""
    chosen: set[str] = set()
    for _, _, bigrams in sorted(template_rows(templates), key=lambda r: len(r[2])):
        spare = len(bigrams) - threshold / (2 - threshold) * len(bigrams)  # may be missing
        left = [b for b in bigrams if not chosen & set(b.split())]
        while len(bigrams) - len(left) <= spare:
            counts: dict[str, int] = {}
            for b in left:
                for w in set(b.split()):
                    counts[w] = counts.get(w, 0) + 1
            # long words are rare in prose: they prune best
            best = max(counts, key=lambda w: (len(w) >= 5, counts[w], len(w), w))
            chosen.add(best)
            left = [b for b in left if best not in b.split()]
    return sorted(chosen)


def likely(text: Column, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Whether a text may match: it holds a keyword, short ones as whole words.

    Plain searches come first, as they cost a fraction of a pattern.
    """
    words = keywords(templates, threshold)
    has = lambda low, ws: reduce(lambda a, b: a | b, [low.contains(w) for w in ws], F.lit(False))
    long, short = [w for w in words if len(w) > 4], [w for w in words if len(w) <= 4]
    whole = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(short)})(?![\p{{L}}\p{{N}}])"
    return let(F.lower(text), lambda low: has(low, long) | (has(low, short) & low.rlike(whole) if short else F.lit(False)))


def _normal_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _bounds(size: Column, threshold: float) -> tuple[Column, Column]:
    return F.ceil(size * (threshold / (2 - threshold)) - 1e-9), F.floor(size * ((2 - threshold) / threshold) + 1e-9)


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, words): lines as l0, l1, ..., paragraphs of several lines as p0, ..., the whole text as t."""
    t = text_or_empty(text)
    named = lambda kind: lambda x, i: F.struct(F.concat(F.lit(kind), i.cast("string")).alias("unit"), x.alias("text"))
    lines = F.transform(F.split(t, "\n"), named("l"))
    paragraphs = F.filter(F.transform(F.split(t, r"\n[\x20\t\r]*\n"), named("p")), lambda u: u["text"].contains("\n"))
    whole = F.when(t.rlike(r"\n[\x20\t\r]*\n"), F.array(F.struct(F.lit("t").alias("unit"), t.alias("text")))).otherwise(F.array().cast("array<struct<unit:string,text:string>>"))
    each = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.concat(lines, paragraphs, whole)).alias("u"))
    return each.select("doc_id", "u.unit", _normal_words(F.col("u.text")).alias("words"))


def template_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(template, license, bigram, number, t_size, t_words, low, high)."""
    fields = ("template", "license", "bigram", "number", "t_size", "t_words")
    rows = [dict(zip(fields, entry, strict=True)) for entry in _template_entries(templates)]
    low, high = _bounds(F.col("t_size"), threshold)
    # one literal: rows made by Python would be unpickled by Python workers
    parsed = F.from_json(F.lit(json.dumps(rows)), "array<struct<template:int,license:string,bigram:string,number:int,t_size:int,t_words:int>>")
    table = spark.range(1).select(F.inline(parsed)).withColumn("low", low).withColumn("high", high)
    return F.broadcast(table) if len(rows) <= BROADCAST_BIGRAMS else table


def _bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def windows(docs: DataFrame, table: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, unit, template, license, common, score): windows of a template's size, named w and their first word's place."""
    words = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array(_normal_words(text_or_empty(text)))).alias("words")).where(F.size("words") >= 2)
    placed = words.select("doc_id", F.size("words").alias("n_words"), F.posexplode(_bigrams(F.col("words"))).alias("pos", "bigram"))
    hits = placed.join(table.select("template", "license", "bigram", "number", "t_size", "t_words"), "bigram")
    need = F.ceil(F.col("t_size") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    lists = hits.groupBy("doc_id", "n_words", "template", "license", "t_size", "t_words").agg(F.sort_array(F.collect_list(F.struct("pos", "number"))).alias("hits")).where(F.size("hits") >= need)

    def scored(start: Column, i: Column) -> Column:
        end = start["pos"] + F.col("t_words") - 1
        inside = F.filter(F.slice("hits", i + 1, F.col("t_words")), lambda x: x["pos"] < end)
        common = F.size(F.array_distinct(F.transform(inside, lambda x: x["number"])))
        length = F.least(F.col("t_words"), F.col("n_words") - start["pos"]) - 1
        enough = F.get("hits", i + need - 1)["pos"] < end
        return F.when(enough, F.struct(start["pos"].alias("pos"), common.alias("common"), (2.0 * common / (common + length - F.size(inside) + F.col("t_size"))).alias("score")))

    found = F.filter(F.transform("hits", scored), lambda w: w["score"] >= threshold)
    each = lists.select("doc_id", "template", "license", F.explode(found).alias("w"))
    return each.select("doc_id", F.concat(F.lit("w"), F.col("w.pos").cast("string")).alias("unit"), "template", "license", F.col("w.common").cast("long").alias("common"), "w.score")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, score, unit): the best unit for each licence that a document matches."""
    sizes = [len(b) for _, _, b in template_rows(templates)]
    least, most = min(sizes) * threshold / (2 - threshold), max(sizes) * (2 - threshold) / threshold
    some = docs.where(likely(F.col(text), templates, threshold))
    numbered = some.select(F.struct(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row")).alias("doc_id"), text)  # repeated ids stay apart
    rows = units(numbered, "doc_id", text)
    n = F.size("words")
    sized = (
        rows.where((n >= 2) & (n - 1 >= least))
        .select("doc_id", "unit", F.explode(F.array(F.array_distinct(_bigrams(F.col("words"))))).alias("bigrams"))
        .withColumn("u_size", F.size("bigrams"))
        .where(F.col("u_size").between(least - 1e-9, most + 1e-9))
        .select("doc_id", "unit", "u_size", F.explode("bigrams").alias("bigram"))
    )
    table = template_table(docs.sparkSession, templates, threshold)
    shared = sized.join(table, (sized["bigram"] == table["bigram"]) & sized["u_size"].between(table["low"], table["high"]))
    of_units = (
        shared.groupBy("doc_id", "unit", "u_size", "template", "license", "t_size").agg(F.count(F.lit(1)).alias("common"))
        .withColumn("score", 2.0 * F.col("common") / (F.col("u_size") + F.col("t_size")))
        .where(F.col("score") >= threshold)
        .select("doc_id", "unit", "template", "license", "common", "score")
    )
    every = of_units.unionByName(windows(numbered, table, threshold, "doc_id", text))
    # one row a unit: its licences of the best rank
    per_unit = every.groupBy("doc_id", "unit").agg(F.max(F.struct("common", "score")).alias("top"), F.collect_set(F.struct("common", "score", "license")).alias("all"))
    winners = per_unit.select("doc_id", "unit", F.explode(F.filter("all", lambda x: (x["common"] == F.col("top.common")) & (x["score"] == F.col("top.score")))).alias("x"))
    best = winners.groupBy("doc_id", F.col("x.license").alias("license")).agg(F.max("x.score").alias("score"), F.min_by("unit", F.struct(-F.col("x.score"), F.length("unit"), "unit")).alias("unit"))
    return best.select(F.col("doc_id.id").alias("doc_id"), "license", "score", "unit")


def licenses_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, license, score, unit), scores to six places."""
    return scan(docs).select("doc_id", "license", F.round("score", 6).alias("score"), "unit")


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The digest in DuckDB SQL, without the bounds."""
    values = ", ".join(f"({i}, '{name}', '{b}', {size}, {words})" for i, name, b, _, size, words in _template_entries(templates))
    words = lambda text: rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"
    blank = r"\n[\x20\t\r]*\n"
    return f"""
WITH templates(template, license, bigram, t_size, t_words) AS (VALUES {values}),
ls AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
ps AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{blank}') AS a FROM documents),
u AS (
  SELECT doc_id, 'l' || (generate_subscripts(a, 1) - 1) AS unit, unnest(a) AS text FROM ls
  UNION ALL SELECT * FROM (SELECT doc_id, 'p' || (generate_subscripts(a, 1) - 1) AS unit, unnest(a) AS text FROM ps) WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, 't', text FROM documents WHERE regexp_matches(text, '{blank}')
),
w AS (SELECT doc_id, unit, {words("u.text")} AS ws FROM u),
g AS (SELECT doc_id, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bs FROM w WHERE len(ws) >= 2),
e AS (SELECT doc_id, unit, len(bs) AS u_size, unnest(bs) AS bigram FROM g),
c AS (SELECT doc_id, unit, license, template, count(*) AS common, 2.0 * count(*) / (u_size + t_size) AS score FROM e JOIN templates USING (bigram) GROUP BY doc_id, unit, u_size, license, template, t_size),
dw AS (SELECT doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
db AS (SELECT doc_id, len(ws) AS n_words, unnest(range(0, len(ws) - 1)) AS pos, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS bigram FROM dw WHERE len(ws) >= 2),
h AS (SELECT * FROM db JOIN templates USING (bigram)),
v AS (
  SELECT a.doc_id, 'w' || a.pos AS unit, a.license, a.template, count(DISTINCT b.bigram) AS common,
         2.0 * count(DISTINCT b.bigram) / (count(DISTINCT b.bigram) + least(a.t_words, a.n_words - a.pos) - 1 - count(*) + a.t_size) AS score
  FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.template = b.template AND b.pos >= a.pos AND b.pos < a.pos + a.t_words - 1
  GROUP BY a.doc_id, a.pos, a.license, a.template, a.t_words, a.n_words, a.t_size
),
every AS (SELECT * FROM c WHERE score >= {threshold} UNION ALL SELECT * FROM v WHERE score >= {threshold}),
m AS (SELECT *, rank() OVER (PARTITION BY doc_id, unit ORDER BY common DESC, score DESC) AS place FROM every),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY score DESC, length(unit), unit) AS k FROM m WHERE place = 1)
SELECT doc_id, license, round(CAST(score AS DOUBLE), 6) AS score, unit FROM r WHERE k = 1
"""
