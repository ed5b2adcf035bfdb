"""Licence scans in DataFrame operations only.

Lines, sentences, paragraphs and whole texts are normalised to words and compared with licence templates by the Dice
coefficient of their sets of word bigrams. As 2 |A & B| / (|A| + |B|) >= t needs t / (2 - t) <= |A| / |B| <= (2 - t) / t,
the sizes prune the templates that a unit meets: units join the templates' bigrams on the bigram and within these
bounds. It needs |A & B| >= |B| t / (2 - t), too: with enough of every template's bigrams holding one of a few telling
words, a text or unit without these words can't match and is passed over before it is cut into words.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let

# Notices and texts of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


def words_of(text: Column) -> Column:
    """Runs of letters a-z and digits of the lower-cased text, with points between digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+(?:\\.[0-9]+)*"), F.lit(0))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words, as 64-bit hashes."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)))


def template_bigrams(spark: SparkSession, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """template, license, size, lo, hi (of unit sizes that can reach `least`), bigram."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "template int, license string, notice string")
    sized = rows.withColumn("grams", bigrams(words_of(F.col("notice")))).withColumn("size", F.size("grams"))
    ratio = (2 - least) / least
    return sized.select("template", "license", "size", F.ceil(F.col("size") / ratio - F.lit(1e-9)).alias("lo"), F.floor(F.col("size") * ratio + F.lit(1e-9)).alias("hi"), F.explode("grams").alias("gram"))


def telling_words(templates: list[tuple[str, str]], least: float) -> list[str]:
    """A few words, long ones that many templates have first, one of which each unit has that reaches `least` with a template.

    Such a unit shares |B| * least / (2 - least) of the template's bigrams, so enough of them must have such a word."""
    grams = [set(zip(w, w[1:], strict=False)) for w in (re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", notice.lower()) for _, notice in templates)]
    chosen: list[str] = []

    def open_ones() -> list[set]:
        rest = [{g for g in b if not set(g) & set(chosen)} for b in grams]
        return [r for r, b in zip(rest, grams, strict=True) if len(r) >= len(b) * least / (2 - least) - 1e-9 and r]

    while rest := open_ones():
        words = sorted({w for r in rest for g in r for w in g})
        chosen.append(max(words, key=lambda w: (len(w) > 5, sum(any(w in g for g in r) for r in rest), len(w))))
    return chosen


def scan_licenses(docs: DataFrame, least: float = 0.7, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each unit that resembles a template: id, unit (line, sentence, paragraph or text), unit_no (from 0), license, dice, bigrams.

    unit and unit_no say which part of the text it is: split by \\n; of the text's sentences, which end at a mark and
    white space and go on over line ends; split at blank lines; or all of it. A paragraph or text of one line is not
    looked at twice, nor a text of one sentence. The most similar template counts, the first of equal ones. Null and
    empty texts have no row; null and repeated ids have their own rows each. Every unit of the whole text is compared;
    those whose size or words no template allows can't match. The templates' bigrams are the only broadcast side, and
    what is shuffled are counts of shared bigrams."""
    spark = docs.sparkSession
    table = template_bigrams(spark, templates, least)
    bounds = table.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).first()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    telling = telling_words(templates, least)

    def tells(t: Column) -> Column:
        return functools.reduce(operator.or_, [F.contains(t, F.lit(w)) for w in telling])

    def units(kind: str, parts: Column) -> Column:
        return F.filter(F.transform(parts, lambda t, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), t.alias("unit_text"))), lambda u: tells(u["unit_text"]))

    def cut(t: Column) -> Column:
        paragraphs = F.split(t, "\n[ \t\r]*\n")
        longer = F.filter(F.concat(units("paragraph", paragraphs), F.when(F.size(paragraphs) > 1, units("text", F.array(t))).otherwise(F.array())), lambda u: F.contains(F.rtrim(u["unit_text"]), F.lit("\n")))
        sentences = F.split(F.regexp_replace(t, "([.!?;:])[ \t\r\n]+", "$1\u0001"), "\u0001")
        return F.concat(units("line", F.split(t, "\n")), let(sentences, lambda s: F.when(F.size(s) > 1, units("sentence", s)).otherwise(F.array())), longer)

    # one expression, so that the lower-cased text is made once
    parts = let(F.lower(text), lambda t: F.when(tells(t), cut(t)).otherwise(F.array()))
    found = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.explode(parts).alias("u")).select("id", "row", "u.*")
    # with k distinct words a unit has k - 1 distinct bigrams at least, so a unit of too many words needs no bigrams
    found = found.withColumn("words", words_of(F.col("unit_text"))).where(F.size("words") > F.lit(bounds["lo"])).where((F.size("words") <= F.lit(bounds["hi"])) | (F.size(F.array_distinct("words")) <= F.lit(bounds["hi"] + 1)))
    found = found.withColumn("grams", bigrams(F.col("words"))).withColumn("n", F.size("grams")).where(F.col("n").between(bounds["lo"], bounds["hi"]))
    shared = found.select("id", "row", "unit", "unit_no", "n", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram").where("n BETWEEN lo AND hi")
    counts = shared.groupBy("id", "row", "unit", "unit_no", "n", "template", "license", "size").agg(F.count("*").alias("both"))
    dice = counts.withColumn("dice", 2.0 * F.col("both") / (F.col("n") + F.col("size"))).where(F.col("dice") >= least)
    best = dice.groupBy("id", "row", "unit", "unit_no", "n").agg(F.max(F.struct("dice", (-F.col("template")).alias("t"), "license")).alias("best"))
    return best.select(F.col("id").alias(id_col), "unit", "unit_no", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), F.col("n").alias("bigrams"))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).select("doc_id", "unit", F.col("unit_no").cast("long").alias("unit_no"), "license", F.round("dice", 6).alias("dice"), F.col("bigrams").cast("long").alias("bigrams"))


def _grams_sql(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z0-9]+(?:\\.[0-9]+)*')"
    return f"list_distinct(list_transform(list_zip({words}[1:-2], {words}[2:]), lambda x: x[1] || ' ' || x[2]))"


def op1_sql(least: float = 0.7) -> str:
    quoted = ", ".join("({}, '{}', '{}')".format(i, name, notice.replace("'", "''")) for i, (name, notice) in enumerate(TEMPLATES))
    return f"""
WITH templates AS (SELECT template, license, {_grams_sql('notice')} AS tg FROM (VALUES {quoted}) t(template, license, notice)),
lines AS (SELECT row, doc_id, 'line' AS unit, i - 1 AS unit_no, parts[i] AS unit_text FROM (
  SELECT row, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
paragraphs AS (SELECT row, doc_id, 'paragraph' AS unit, i - 1 AS unit_no, parts[i] AS unit_text, len(parts) AS np, text FROM (
  SELECT row, doc_id, text, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT row_number() OVER () AS row, doc_id, text, regexp_split_to_array(coalesce(text, ''), '\\n[ \\t\\r]*\\n') AS parts FROM documents))),
sentences AS (SELECT row, doc_id, 'sentence' AS unit, i - 1 AS unit_no, parts[i] AS unit_text FROM (
  SELECT row, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT row_number() OVER () AS row, doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)) WHERE len(parts) > 1),
units AS (SELECT * FROM lines UNION ALL SELECT * FROM sentences
  UNION ALL SELECT row, doc_id, unit, unit_no, unit_text FROM paragraphs WHERE contains(rtrim(unit_text, ' '), chr(10))
  UNION ALL SELECT row, doc_id, 'text', 0, text FROM paragraphs WHERE unit_no = 0 AND np > 1 AND contains(rtrim(text, ' '), chr(10))),
grams AS (SELECT row, doc_id, unit, unit_no, {_grams_sql('unit_text')} AS g FROM units),
small AS (SELECT * FROM grams WHERE len(g) BETWEEN 1 AND 600),
dice AS (SELECT row, doc_id, unit, unit_no, len(g) AS n, license, template, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS d
  FROM small, templates WHERE len(g) * {2 - least} + 1e-9 >= len(tg) * {least} AND len(g) * {least} <= len(tg) * {2 - least} + 1e-9)
SELECT doc_id, unit, unit_no::BIGINT AS unit_no, license, round(d, 6) AS dice, n::BIGINT AS bigrams FROM dice WHERE d >= {least}
QUALIFY row_number() OVER (PARTITION BY row, doc_id, unit, unit_no ORDER BY d DESC, template) = 1
"""


OP1_SQL = op1_sql()
