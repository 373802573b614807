"""Licence scans: Dice coefficient of normalised text and licence templates over word bigrams, in DataFrame operations only.

A passage is the whole text, a paragraph or a line. Two sets of a and b bigrams reach a Dice coefficient t only if
a*t/(2-t) <= b <= a*(2-t)/t, so templates outside these bounds are not compared. Notices within a longer passage, and those
that line breaks or comment marks interrupt, are met by windows: as many words of the text as the template has, from
each place where a run of its bigrams begins.
"""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DICE = 0.8

# Notices and license texts as their publishers print them (public texts), one passage each.
NOTICES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", 'Eclipse Public License - v 2.0 THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.'),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
]

#: Names that a source file may declare in one line.
DECLARED = ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "ISC", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
#: Whole licences as published (placeholders for the holder and year), one file for each name.
TEXTS = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
TEMPLATES: list[tuple[str, str]] = [*NOTICES, *((n, f"SPDX-License-Identifier: {n}") for n in DECLARED), *TEXTS]


def _words(passage: Column) -> Column:
    return F.filter(F.split(F.lower(passage), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """Hashes of all word bigrams in order; none for under two words."""
    some = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= 2, some(w)).otherwise(F.array().cast("array<bigint>")))[0]


def compiled(spark, templates: list[tuple[str, str]], dice: float) -> list[dict]:
    """Bigram hashes, their number in order (span) and size bounds of each template; templates under two words are ignored."""
    frame = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(templates)], "n int, name string, text string")
    rows = frame.withColumn("w", _words(F.col("text"))).where(F.size("w") >= 2).select("n", "name", F.size("w").alias("words"), F.array_distinct(_pairs(F.col("w"))).alias("grams")).orderBy("n").collect()
    return [{"name": r.name, "size": len(r.grams), "span": r.words - 1, "least": len(r.grams) * dice / (2 - dice) - 1e-9, "most": len(r.grams) * (2 - dice) / dice + 1e-9, "grams": list(r.grams)} for r in rows]


def _passages(text: str, literal: Column, least: float, dice: float) -> Column:
    """For each different passage of the text that matches: array<struct(dice, name)> of the templates it matches."""
    passages = F.array_distinct(F.flatten(F.array(F.array(F.col(text)), F.split(text, r"\n[ \t\r]*\n"), F.split(text, "\n"))))

    def matches(grams: Column) -> Column:
        n = F.size(grams)
        fit = F.filter(literal, lambda t: (n >= t["least"]) & (n <= t["most"]))
        scored = F.transform(fit, lambda t: F.struct((F.size(F.array_intersect(grams, t["grams"])) * F.lit(2.0) / (n + t["size"])).alias("dice"), t["name"].alias("name")))
        return F.filter(scored, lambda s: s["dice"] >= dice)

    enough = F.filter(F.transform(passages, _words), lambda w: (F.size(w) >= 2) & (F.size(w) - 1 >= least))
    return F.filter(F.transform(F.transform(enough, lambda w: F.array_distinct(_pairs(w))), matches), lambda m: F.size(m) > 0)


def _windows(pairs: Column, hits: Column, literal: Column, dice: float) -> Column:
    """array<struct(dice, name)> of templates that a window matches, with the best window's coefficient.

    ``hits`` are the places of ``pairs`` that hold a bigram of any template. A window needs as many as a template's lower
    bound, which the place of the hit so much further on tells at once.
    """
    place = lambda i: F.struct(i.alias("i"), F.get(pairs, i).alias("g"))

    def best(t: Column) -> Column:
        own = F.transform(F.filter(hits, lambda i: F.array_contains(t["grams"], F.get(pairs, i))), place)

        def over(p: Column) -> Column:
            need = F.ceil(t["least"]).cast("int")
            within = lambda x, j: F.coalesce(F.get(p, j + need - 1)["i"] < x["i"] + t["span"], F.lit(False))
            begins = lambda x, j: (j == 0) | (F.get(p, j - 1)["i"] < x["i"] - 1)
            starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda j: begins(F.get(p, j), j) & within(F.get(p, j), j))

            def value(j: Column) -> Column:
                at = F.get(p, j)["i"]
                shared = F.size(F.array_distinct(F.transform(F.filter(F.slice(p, j + 1, t["span"]), lambda x: x["i"] < at + t["span"]), lambda x: x["g"])))
                return shared * F.lit(2.0) / (F.size(F.array_distinct(F.slice(pairs, at + 1, t["span"]))) + t["size"])

            return F.when(F.size(p) > 0, F.array_max(F.transform(starts, value)))

        return F.struct(F.transform(F.array(own), over)[0].alias("dice"), t["name"].alias("name"))

    met = F.array_distinct(F.transform(hits, lambda i: F.get(pairs, i)))
    likely = F.transform(F.array(met), lambda m: F.filter(literal, lambda t: (F.size(m) >= t["least"]) & (F.size(F.array_intersect(m, t["grams"])) >= t["least"])))[0]
    return F.filter(F.transform(likely, best), lambda s: s["dice"] >= dice)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE, text: str = "text") -> DataFrame:
    """``docs`` with ``licences`` (sorted names met), ``best_licence``, ``best_dice`` (rounded to 6 places), ``n_passages`` (passages that match) and ``n_windows`` (templates that a window matches).

    Passages are the different ones among the text, its paragraphs (between blank lines) and its lines; words are runs of
    letters and digits, lower-cased, so that comment marks and line ends between them do not count; a passage or window
    counts if its Dice coefficient with a template reaches ``dice``. A window at the end of the text may be shorter. Null
    or empty texts and passages under two words match nothing: an empty array, nulls and 0. Long texts are compared
    whole. Ties go to the name first in the alphabet. Rows are independent, repeated rows equal; columns of the same
    names are replaced, others kept. One pass, no shuffle; the templates are part of the plan.
    """
    table = compiled(docs.sparkSession, templates, dice)
    least = min((t["least"] for t in table), default=0.0)
    literal = F.from_json(F.lit(json.dumps(table)), "array<struct<name:string,size:int,span:int,least:double,most:double,grams:array<bigint>>>")
    new = ("licences", "best_licence", "best_dice", "n_passages", "n_windows")
    work = docs.drop(*new)
    kept = work.columns
    scored, every = "array<struct<dice:double,name:string>>", sorted({g for t in table for g in t["grams"]}) or [0]
    work = work.withColumn("__found", F.coalesce(_passages(text, literal, least, dice), F.array().cast(f"array<{scored}>")))
    work = work.withColumn("__pairs", _pairs(F.coalesce(_words(F.col(text)), F.array().cast("array<string>"))))
    work = work.withColumn("__hits", F.expr(f"filter(transform(__pairs, (g, i) -> if(g in ({','.join(map(str, every))}), i, null)), i -> i is not null)"))
    work = work.withColumn("__windows", F.coalesce(_windows(F.col("__pairs"), F.col("__hits"), literal, dice), F.array().cast(scored)))
    work = work.withColumn("__every", F.concat(F.flatten("__found"), F.col("__windows")))
    top = F.array_max(F.transform("__every", lambda s: s["dice"]))
    names = F.array_sort(F.array_distinct(F.transform("__every", lambda s: s["name"])))
    best = F.array_min(F.transform(F.filter("__every", lambda s: s["dice"] == top), lambda s: s["name"]))
    return work.select(*kept, names.alias("licences"), best.alias("best_licence"), F.round(top, 6).alias("best_dice"), F.size("__found").alias("n_passages"), F.size("__windows").alias("n_windows"))


def sql(templates: list[tuple[str, str]] = TEMPLATES, dice: float = DICE) -> str:
    """The same in DuckDB: ``documents`` to doc_id, licences (joined), best_licence, best_dice, n_passages, n_windows."""
    rows = ",\n".join("({}, '{}', '{}')".format(n, name, text.replace("'", "''")) for n, (name, text) in enumerate(templates))
    split = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
WITH tw AS (SELECT id, name, {split.format("text")} AS w FROM (VALUES {rows}) AS t(id, name, text)),
t AS (SELECT id, name, len(w) - 1 AS span, list_distinct({pairs}) AS grams FROM tw WHERE len(w) >= 2),
p AS (SELECT doc_id, unnest(list_distinct(list_concat([text], regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), string_split(text, chr(10))))) AS passage FROM documents WHERE text IS NOT NULL),
pw AS (SELECT doc_id, passage, {split.format("passage")} AS w FROM p),
pg AS (SELECT doc_id, passage, list_distinct({pairs}) AS grams FROM pw WHERE len(w) >= 2),
m AS (SELECT doc_id, passage, name, 2.0 * len(list_intersect(pg.grams, t.grams)) / (len(pg.grams) + len(t.grams)) AS dice
      FROM pg JOIN t ON len(pg.grams) BETWEEN len(t.grams) * {dice} / (2 - {dice}) - 1e-9 AND len(t.grams) * (2 - {dice}) / {dice} + 1e-9),
dw AS (SELECT doc_id, {split.format("text")} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest({pairs}) AS gram, unnest(range(1, len(w))) AS pos FROM dw WHERE len(w) >= 2),
tg AS (SELECT id, unnest(grams) AS gram FROM t),
h0 AS (SELECT doc_id, id, pos, gram FROM g JOIN tg USING (gram)),
few AS (SELECT doc_id, h0.id FROM h0 JOIN t ON h0.id = t.id GROUP BY doc_id, h0.id, len(grams) HAVING count(DISTINCT gram) >= len(grams) * {dice} / (2 - {dice}) - 1e-9),
h AS (SELECT h0.* FROM h0 SEMI JOIN few ON h0.doc_id = few.doc_id AND h0.id = few.id),
s AS (SELECT doc_id, id, pos AS begin FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id, id ORDER BY pos) AS last FROM h) WHERE last IS NULL OR last < pos - 1),
wi AS (SELECT s.doc_id, s.id, begin, count(DISTINCT gram) AS n FROM s JOIN t ON s.id = t.id JOIN h ON h.doc_id = s.doc_id AND h.id = s.id AND pos BETWEEN begin AND begin + span - 1 GROUP BY ALL),
wa AS (SELECT s.doc_id, s.id, begin, count(DISTINCT gram) AS n FROM s JOIN t ON s.id = t.id JOIN g ON g.doc_id = s.doc_id AND pos BETWEEN begin AND begin + span - 1 GROUP BY ALL),
wd AS (SELECT wi.doc_id, wi.id, name, max(2.0 * wi.n / (wa.n + len(grams))) AS dice FROM wi JOIN wa ON wi.doc_id = wa.doc_id AND wi.id = wa.id AND wi.begin = wa.begin JOIN t ON t.id = wi.id GROUP BY ALL),
nw AS (SELECT doc_id, count(*) AS n FROM wd WHERE dice >= {dice} GROUP BY doc_id),
hit AS (SELECT * FROM m WHERE dice >= {dice} UNION ALL SELECT doc_id, NULL, name, dice FROM wd WHERE dice >= {dice}),
top AS (SELECT doc_id, max(dice) AS d FROM hit GROUP BY doc_id),
best AS (SELECT hit.doc_id, min(name) AS best_licence FROM hit JOIN top ON hit.doc_id = top.doc_id AND dice = d GROUP BY hit.doc_id),
su AS (SELECT hit.doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, round(max(dice), 6) AS best_dice, count(DISTINCT passage) AS n FROM hit GROUP BY hit.doc_id)
SELECT d.doc_id, coalesce(licences, '') AS licences, best_licence, best_dice, CAST(coalesce(su.n, 0) AS INTEGER) AS n_passages, CAST(coalesce(nw.n, 0) AS INTEGER) AS n_windows
FROM documents d LEFT JOIN su ON d.doc_id = su.doc_id LEFT JOIN best ON d.doc_id = best.doc_id LEFT JOIN nw ON d.doc_id = nw.doc_id
"""


def plain_words(text: str) -> list[str]:
    """What ``_words`` does, in plain Python, for tests."""
    return re.findall(r"[^\W_]+", text.lower())
