"""License scans by sparse TF-IDF cosine and directory inheritance; DataFrame operations only.

A file is compared as a whole, by its header (the first paragraph), and by its other
paragraphs, lines and sentences, all over its whole text. Each distinct one of these units
becomes a sparse TF-IDF vector (document frequencies are the templates'; stop words don't
count, words of no template weigh most) and is compared with every template, notices and full
texts, by joining on the words they share. Weights are integers, so sums are exact in any
order. Units that cannot reach THRESHOLD with any template are told from a bound that the
threshold implies, before words are dealt out; nothing that could reach it is passed over.

A file's own license is that of its unit with the greatest cosine of at least THRESHOLD; of
equal ones the template listed first, then the larger unit. Licence files (by name, or because
the whole file is a license) speak for their directory; a file without a license of its own
takes that of the nearest ancestor directory that has one: distinct directories are joined
with their ancestors' licenses on the path, and the deepest wins.

Copies of a unit are compared once. Files meet units and directories in equi-joins, which AQE
may split where a notice or a directory is hot; no file travels with its text.

Defined results: null and empty texts have no license of their own but may inherit; null paths
neither speak for a directory nor inherit; rows are told apart by key, path and text, so rows
of one key or path keep their own licenses and rows that repeat get equal results; very long
texts are taken whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_TERMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."

#: Notices, headers and full texts by license, in order of preference.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", f"MIT License {_MIT} {_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License, Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GPL.format(2)),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_TERMS} {_BSD_WARRANTY}"),
    ("ISC", "ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0, Creative Commons Attribution ShareAlike License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal license."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Words that tell no license from another.
STOP = frozenset("http www org a all an and any are as at be by do for form from if in is it its may must no nor not of on one or other out see shall so that the this to was whether whom will with within you your".split())
#: Over what one word of a short notice alone can reach (German "mit" 0.67 to the shortest MIT notice).
THRESHOLD = 0.7
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
#: What parts paragraphs, and lines; sentences become lines by SENTENCE.
PARAGRAPH, LINE, SENTENCE = r"\n[ \t\r]*\n\s*", r"\n+", r"([.;!?])[ \t]+"
LICENCE_FILE = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
#: Units of a weight and of a template's unit vector.
UNIT, NORM = 1000, 1_000_000
KINDS = ("file", "header", "passage")


def vectors(templates=TEMPLATES) -> tuple[dict[str, int], int, list[dict[str, int]]]:
    """Weights of words (and of unknown ones) in 1 / UNIT, and the templates' unit vectors in 1 / NORM."""
    counts = []
    for _, text in templates:
        words = [w for w in re.findall(TOKEN, text.lower()) if w not in STOP]
        counts.append({w: words.count(w) for w in words})
    n = len(templates)
    idf = {w: round(UNIT * (math.log((n + 1) / (1 + sum(w in c for c in counts))) + 1)) for c in counts for w in c}
    units = []
    for c in counts:
        v = {w: k * idf[w] for w, k in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        units.append({w: round(NORM * x / norm) for w, x in v.items()})
    return idf, round(UNIT * (math.log(n + 1) + 1)), units


#: Words of the templates that are frequent in any prose, the most frequent first: the bound does without them where it can.
COMMON = """2 3 mit but can more use under into even see means way used such either such work free general public file files list including
following later language version 2 3 4.0 2.0 1.0 v software program person persons without terms name names code data source
particular required subject special rights useful charge option provided however writing whole above met caused loss services
event action law conditions purpose form written specific prior kind limited direct products business library agreed appear
published publish sell deal copy copies claim included hope anyone applicable associated basis available strict theory goods
details distributed distribute distribution materials cc sa nc org www by""".split()


def needed(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit with a cosine of at least the threshold to some template has one.

    The cosine is at most the norm of the template's unit vector over the words they share. So
    words whose squares sum to less than threshold ** 2 can't reach it alone: the most frequent ones,
    then the lightest, are left out while that holds, and a unit needs one of the rest.
    """
    out: set[str] = set()
    for unit in vectors(templates)[2]:
        rest = 0.0
        for w in sorted(unit, key=lambda w: (COMMON.index(w) if w in COMMON else len(COMMON), unit[w], w)):
            if rest + (unit[w] / NORM) ** 2 < threshold**2 - 1e-4:
                rest += (unit[w] / NORM) ** 2
            else:
                out.add(w)
    return sorted(out)


def _postings(spark: SparkSession, templates) -> DataFrame:
    """(word, idf, t, x): some hundred rows whatever the input."""
    idf, _, units = vectors(templates)
    return spark.createDataFrame([(w, idf[w], t, x) for t, u in enumerate(units) for w, x in u.items()], "word string, idf long, t int, x long")


def _array(values) -> Column:
    """A literal array in one call, unlike F.lit of a list."""
    return F.expr(f"array({', '.join(repr(v) if isinstance(v, str) else f'{v}D' for v in values)})")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def _reaches(text: Column, templates, threshold: float) -> Column:
    """Whether a unit's cosine can reach the threshold with some template, row by row.

    The part of the unit's norm that lies on words of templates must be at least the threshold
    of the whole; words of no template count once in it, those of templates as often as they occur.
    """
    idf, unknown, _ = vectors(templates)
    known = sorted(idf)
    words, weights, plain = _array(known), _array([float(idf[w]) for w in known]), _array(sorted(STOP | idf.keys()))
    must = _array(needed(templates, threshold))

    def check(t):
        times = lambda w: (F.size(t) - F.size(F.array_remove(t, w))) * F.get(weights, F.array_position(words, w).cast("int") - 1)
        norm2 = F.aggregate(F.array_intersect(t, words), F.lit(0.0), lambda s, w: s + times(w) * times(w))
        rest = F.size(F.array_except(t, plain)) * F.lit(float(unknown) ** 2)
        return F.arrays_overlap(t, must) & (norm2 >= (norm2 + rest) * F.lit(threshold**2 - 1e-5))

    return F.exists(F.array(_tokens(text)), check)


def classify(units: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(k, t, cosine) of distinct units(k, unit): the best template of those at or over the threshold."""
    postings = _postings(units.sparkSession, templates)
    unknown = vectors(templates)[1]
    key = units.select("k", "unit").dropDuplicates(["k"])
    words = key.select("k", F.explode(_tokens(F.col("unit"))).alias("word")).where(~F.col("word").isin(*sorted(STOP)))
    tf = words.groupBy("k", "word").agg(F.count(F.lit(1)).alias("tf"))
    # A row a word of the templates.
    by_word = F.broadcast(postings.groupBy("word", "idf").agg(F.collect_list(F.struct("t", "x")).alias("ts")))
    weighted = tf.join(by_word, "word", "left").select("k", (F.col("tf") * F.coalesce("idf", F.lit(unknown))).alias("w"), "ts")
    # A word of no template adds to the norm alone (template -1); one of some templates to the norm and their dots.
    none = F.array().cast("array<struct<t:int,x:long>>")
    parts = weighted.select("k", "w", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("t"), F.col("w").alias("x"))), F.coalesce("ts", none))).alias("p"))
    sums = parts.groupBy("k", F.col("p.t").alias("t")).agg(F.sum(F.col("w") * F.col("p.x")).alias("s"))
    both = sums.groupBy("k").agg(F.max(F.when(F.col("t") == -1, F.col("s"))).alias("norm2"), F.max(F.when(F.col("t") >= 0, F.struct("s", (-F.col("t")).alias("order")))).alias("best"))
    return both.select("k", (-F.col("best.order")).alias("t"), F.least(F.round(F.col("best.s") / F.sqrt("norm2") / F.lit(float(NORM)), 6), F.lit(1.0)).alias("cosine")).where(F.col("cosine") >= threshold)


def _units(text: Column) -> Column:
    """(kind, unit) of the whole text, its header and its other paragraphs, lines and sentences, each distinct one once."""
    paragraphs = F.split(text, PARAGRAPH)
    lines = F.split(F.regexp_replace(text, SENTENCE, "$1\n"), LINE)
    rest = F.array_except(F.array_distinct(F.concat(paragraphs, lines)), F.array(text, F.get(paragraphs, F.lit(0))))
    head = F.array_except(F.array(F.get(paragraphs, F.lit(0))), F.array(text))
    some = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("unit")))
    return F.concat(some(0, F.array(text)), some(1, head), some(2, rest))


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit(""))


def scan(files: DataFrame, path: Column, text: Column, key: Column, speaks: Column | None = None, closing: bool = False, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, license, score, unit, origin, from_dir) of every file.

    speaks: whether a file is a licence file, by default from its name. closing: a file whose
    last line is a notice speaks for its directory too.
    """
    names = _array([n for n, _ in templates])
    named = F.coalesce(path.rlike(LICENCE_FILE) if speaks is None else speaks, F.lit(False))
    rows = files.select(key.alias("key"), path.alias("path"), F.coalesce(text, F.lit("")).alias("text"), named.alias("speaks"))
    same = F.md5(F.col("text").cast("binary")).alias("digest")
    must = F.array_intersect(_tokens(F.col("text")), _array(needed(templates, threshold)))
    units = rows.withColumn("must", must).where(F.size("must") > 0).select("key", "path", same, "speaks", "must", F.substring_index(F.rtrim(F.col("text")), "\n", -1).alias("last"), F.explode(_units(F.col("text"))).alias("u"))
    units = units.where(F.exists("must", lambda w: F.contains(F.lower("u.unit"), w))).select("key", "path", "digest", "last", "speaks", "u.kind", "u.unit").where(_reaches(F.col("unit"), templates, threshold))
    ends = F.array_contains(F.split(F.regexp_replace("last", SENTENCE, "$1\n"), LINE), F.col("unit")) if closing else F.lit(False)
    speaking = F.col("speaks") | (F.col("kind") == 0) | ends
    units = materialise(units.select("key", "path", "digest", speaking.alias("speaks"), "kind", F.sha2("unit", 256).alias("k"), "unit"), "license-units")
    best = units.drop("unit").join(classify(units, templates, threshold), "k")
    rank = F.struct("cosine", (-F.col("t")).alias("order"), (-F.col("kind")).alias("size"))
    own = best.groupBy("key", "path", "digest").agg(F.max(rank).alias("own"), F.max("speaks").alias("speaks"))
    spoken = own.where("speaks AND path IS NOT NULL").groupBy(folder(F.col("path")).alias("from_dir")).agg(F.max("own").alias("theirs"))
    dirs = rows.where("path IS NOT NULL").select(folder(F.col("path")).alias("dir")).distinct()
    split = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(split)), lambda n: F.struct(F.concat_ws("/", F.slice(split, 1, n)).alias("a"), n.alias("depth")))
    above = dirs.select("dir", F.explode(F.array_distinct(F.when(F.col("dir") == "", F.array(F.struct(F.lit("").alias("a"), F.lit(0).alias("depth")))).otherwise(steps))).alias("x")).select("dir", F.col("x.a").alias("from_dir"), F.col("x.depth").alias("depth"))
    nearest = above.join(spoken, "from_dir").groupBy("dir").agg(F.max(F.struct("depth", "from_dir", "theirs")).alias("up"))
    files_ = rows.select("key", "path", same).withColumn("dir", folder(F.col("path")))
    owned = own.select(F.col("key").alias("k2"), F.col("path").alias("p2"), F.col("digest").alias("d2"), "own")
    joined = files_.join(owned, (F.col("digest") == F.col("d2")) & F.col("key").eqNullSafe(F.col("k2")) & F.col("path").eqNullSafe(F.col("p2")), "left").join(nearest, "dir", "left")
    mine = F.col("own").isNotNull()
    has = F.col("up").isNotNull() & F.col("path").isNotNull()
    used = F.when(mine, F.col("own")).otherwise(F.when(has, F.col("up.theirs")))
    return joined.select(
        "key", "path", F.get(names, -used["order"]).alias("license"), used["cosine"].alias("score"), F.when(mine, F.get(_array(KINDS), -F.col("own.size"))).alias("unit"),
        F.when(mine, "own").when(has, "inherited").otherwise("none").alias("origin"), F.when(~mine & has, F.col("up.from_dir")).alias("from_dir"),
    )


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Licenses of all documents, filed as source / thousands / hundreds / id; a document that ends in a notice, or is one, speaks for its directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    d = F.col("doc_id")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.floor(d / 1000).cast("string"), F.lit("/"), F.floor(d / 100).cast("string"), F.lit("/"), d.cast("string"))
    found = scan(docs, path, F.col("text"), d, F.lit(False), closing=True)
    return found.withColumnRenamed("key", "doc_id")


def op9_sql() -> str:
    """The same over whole tables in DuckDB: every unit is scored, without the bound."""
    idf, unknown, units = vectors()
    values = ", ".join(f"('{w}', {idf[w]}, {t}, {x})" for t, u in enumerate(units) for w, x in u.items())
    names = ", ".join(f"({t}, '{n}')" for t, (n, _) in enumerate(TEMPLATES))
    stop = ", ".join(f"'{w}'" for w in sorted(STOP))
    parts = lambda text, by: f"string_split_regex({text}, '{by}')"
    lines = lambda text: parts(f"regexp_replace({text}, '{SENTENCE}', E'\\1\n', 'g')", LINE)
    return rf"""
WITH p(word, idf, t, x) AS (VALUES {values}), n(t, license) AS (VALUES {names}),
f AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        coalesce(source, 'none') || '/' || CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents),
s AS (SELECT r, text, {parts('text', PARAGRAPH)} AS ps, {lines('text')} AS ls, {lines("string_split(rtrim(text, ' '), chr(10))[-1]")} AS ends FROM f),
a AS (SELECT r, ends, unnest(list_distinct([{{'kind': 0, 'unit': text}}, {{'kind': 1, 'unit': ps[1]}}] || list_transform(ps || ls, lambda v: {{'kind': 2, 'unit': v}}))) AS u FROM s),
b AS (SELECT r, u.unit AS unit, min(u.kind) AS kind, any_value(ends) AS ends FROM a GROUP BY 1, 2),
k AS (SELECT DISTINCT unit FROM b),
w AS (SELECT unit, word, count(*) AS tf FROM (SELECT unit, unnest(regexp_extract_all(lower(unit), '{TOKEN}')) AS word FROM k) WHERE word NOT IN ({stop}) GROUP BY 1, 2),
i AS (SELECT DISTINCT word, idf FROM p),
v AS (SELECT unit, w.word, tf * coalesce(idf, {unknown}) AS w FROM w LEFT JOIN i ON w.word = i.word),
m AS (SELECT unit, CAST(sum(w * w) AS DOUBLE) AS norm2 FROM v GROUP BY 1),
g AS (SELECT unit, t, sum(w * x) AS dot FROM v JOIN p ON v.word = p.word GROUP BY 1, 2),
h AS (SELECT unit, max(struct_pack(dot := dot, o := -t)) AS best FROM g GROUP BY 1),
c AS (SELECT unit, best.o AS o, least(round(CAST(best.dot AS DOUBLE) / sqrt(norm2) / {NORM}.0::DOUBLE, 6), 1.0::DOUBLE) AS cosine FROM h JOIN m USING (unit)),
o AS (SELECT r, max(struct_pack(cosine := cosine, o := o, size := -kind)) AS own, bool_or(kind = 0 OR list_contains(ends, unit)) AS speaks FROM b JOIN c USING (unit) WHERE cosine >= {THRESHOLD} GROUP BY 1),
d AS (SELECT r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own, speaks FROM f LEFT JOIN o USING (r)),
y AS (SELECT dir AS from_dir, max(own) AS theirs FROM d WHERE speaks AND path IS NOT NULL GROUP BY 1),
l AS (SELECT dir, array_to_string(string_split(dir, '/')[1:unnest(range(0, len(string_split(dir, '/')) + 1))], '/') AS from_dir FROM (SELECT DISTINCT dir FROM d WHERE dir IS NOT NULL)),
z AS (SELECT dir, arg_max(from_dir, length(from_dir)) AS from_dir, arg_max(theirs, length(from_dir)) AS theirs FROM l JOIN y USING (from_dir) GROUP BY 1)
SELECT doc_id, path, license, (CASE WHEN own IS NOT NULL THEN own ELSE theirs END).cosine AS score,
  CASE own.size WHEN 0 THEN 'file' WHEN -1 THEN 'header' WHEN -2 THEN 'passage' END AS unit,
  CASE WHEN own IS NOT NULL THEN 'own' WHEN theirs IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, CASE WHEN own IS NULL THEN z.from_dir END AS from_dir
FROM d LEFT JOIN z USING (dir) LEFT JOIN n ON n.t = -(CASE WHEN own IS NOT NULL THEN own ELSE theirs END).o
"""
