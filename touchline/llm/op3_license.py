"""Licence scan by the Dice coefficient over word bigrams (native).

Texts are normalised (lower case, only letters and digits), so line breaks and layout
do not count, and cut into word bigrams. A passage can reach a Dice coefficient of t
with a template of b bigrams only if it holds t*b/(2-t) of them, so it holds one of any
b - t*b/(2-t) + 1: the template's anchors, its rarest and longest. Where a text has an
anchor, the window around the passage that puts the anchor in its place is looked at: the
template's length and, on both sides, as many bigrams more as the size bound b*(2-t)/t
allows, so inserted words push nothing out. Its best stretch is found by sums: at a rate of
t/2 a bigram, then at half the Dice coefficient of the first find (bigrams that recur in the
window count once). So notices are found inside long lines, over several lines and anywhere in a
document, and whole licences as well; very long licences by the notice at their end.

Everything about a text is computed in its row: no shuffle, no join; templates are a
parameter, so bounded, and stand in the plan as constants. The work grows with the
length of the text and the number of its anchors.

Defined results: one row per row of the table, also for null ids; no passage at or over
the threshold, null and empty texts: license null, dice 0, n_hits 0; n_hits counts
passages (a template and the ends of its stretch) at or over the threshold. The license is
that of the passage that shares most bigrams with its template, so a whole licence counts
before a sentence that it shares with others; then by Dice, most bigrams, and the template
that comes first. A sentence that several licences begin with stands for their family (BSD).
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import table

THRESHOLD = 0.8
_BACK = 1 << 20

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

# Short notices by which texts state their licence, then whole licences and the notices that long ones end with.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
""" + _BSD_DISCLAIMER),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
""" + _BSD_DISCLAIMER),
    ("Unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
]


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = words_of(text)
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def anchors_of(templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """Bigram, template and place of every occurrence of the templates' anchors."""
    rows = [bigrams(text) for _, text in templates]
    spread = Counter(g for grams in rows for g in set(grams))
    found = []
    for k, grams in enumerate(rows):
        b = len(set(grams))
        needed = math.ceil(threshold * b / (2 - threshold) - 1e-9)
        own = set(sorted(set(grams), key=lambda g: (spread[g], -len(g), g))[: b - needed + 1])
        found += [(g, k, i) for i, g in enumerate(grams) if g in own]
    return found


def given(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, also where f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _constant(value: object, kind: str) -> Column:
    """A nested constant, which Spark folds into one literal."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def more_grams(grams: list[str], threshold: float = THRESHOLD) -> int:
    """Bigrams that a passage may have beyond the template's: the size bound."""
    b = len(set(grams))
    return math.floor(b * (2 - threshold) / threshold + 1e-9) - b


def _stretch(marks: Column, rate: Column) -> Column:
    """s and e of the stretch of marks with the greatest sum, where a template's bigram counts 1 - rate, another one -rate, and one that came before 0.

    A stretch of n bigrams, h of them the template's, has a Dice coefficient of 2 * rate or more if and only if h - rate * n is rate * b or more.
    """

    def step(a: Column, m: Column) -> Column:
        worth = F.when(m["again"], 0.0).when(m["hit"], 1.0 - rate).otherwise(-rate)
        total = F.when(a["sum"] <= 0, worth).otherwise(a["sum"] + worth)
        at = F.when(a["sum"] <= 0, a["i"]).otherwise(a["at"])
        better = total > a["top"] + 1e-9
        kept = lambda new, c: F.when(better, new).otherwise(a[c]).alias(c)
        return F.struct(total.alias("sum"), at.alias("at"), kept(total, "top"), kept(at, "s"), kept(a["i"], "e"), (a["i"] + 1).alias("i"))

    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(0.0).alias("top"), F.lit(0).alias("s"), F.lit(-1).alias("e"), F.lit(0).alias("i"))
    return F.aggregate(marks, zero, step)


def passages_found(text: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """array of (shared, dice, b, order, s, e) of all passages at or over the threshold; order is the template's place, negative."""
    rows = [bigrams(t) for _, t in templates]
    held = _constant([{"length": len(grams), "b": len(set(grams)), "more": more_grams(grams, threshold), "grams": list(dict.fromkeys(grams))} for grams in rows], "array<struct<length:int,b:int,more:int,grams:array<string>>>")
    # A template and a start in one long: the template above 40 bits, the start (from -BACK) below.
    places: dict[str, list[int]] = {}
    for g, k, i in anchors_of(templates, threshold):
        places.setdefault(g, []).append((k << 40) - i + _BACK)
    index = _constant(places, "map<string,array<bigint>>")
    names = list(places)

    def scored(grams: Column, code: Column) -> Column:
        template, start = F.shiftright(code, 40).cast("int"), (code % (1 << 40) - _BACK).cast("int")

        def compared(t: Column) -> Column:
            low = F.greatest(start - t["more"], F.lit(0))
            window = F.slice(grams, low + 1, F.least(start + t["length"] + t["more"], F.size(grams)) - low)

            def best(w: Column) -> Column:
                marks = F.transform(w, lambda g, i: F.struct(F.array_contains(t["grams"], g).alias("hit"), (F.array_position(w, g) <= i).alias("again")))

                def measured(k: Column) -> Column:
                    part = F.array_distinct(F.slice(w, k["s"] + 1, k["e"] - k["s"] + 1))
                    shared = F.size(F.array_intersect(part, t["grams"]))
                    return F.struct((2.0 * shared / (F.size(part) + t["b"])).alias("dice"), (low + k["s"]).alias("s"), (low + k["e"]).alias("e"), shared.alias("shared"))

                def refined(m: Column) -> Column:
                    first = given(_stretch(m, F.lit(threshold / 2)), measured)
                    return given(first, lambda x: F.array_max(F.array(x, given(_stretch(m, x["dice"] / 2), measured))))

                return given(marks, refined)

            return given(given(window, best), lambda x: F.struct(x["shared"].alias("shared"), x["dice"].alias("dice"), t["b"].alias("b"), (-template).alias("order"), x["s"].alias("s"), x["e"].alias("e")))

        return given(F.element_at(held, template + 1), compared)

    def searched(grams: Column) -> Column:
        hits = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda h: h["g"].isin(names))
        codes = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(index, h["g"]), lambda c: c + h["i"]))))
        return F.array_distinct(F.filter(F.transform(codes, lambda c: scored(grams, c)), lambda x: x["dice"] >= threshold))

    def of_words(w: Column) -> Column:
        n = F.size(w) - 1
        grams = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
        return given(grams, lambda g: F.when(F.arrays_overlap(g, F.map_keys(index)), searched(g)).otherwise(F.array().cast("array<struct<shared:int,dice:double,b:int,order:int,s:int,e:int>>")))

    return given(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ", -1), of_words)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, n_hits of each row."""
    templates = TEMPLATES if templates is None else templates
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if not templates or not all(bigrams(t) for _, t in templates):
        raise ValueError("a template needs two words at least")
    found = passages_found(F.coalesce(F.col(text_col).cast("string"), F.lit("")), templates, threshold)
    names = F.array(*[F.lit(name) for name, _ in templates])

    def summed(x: Column) -> Column:
        return F.struct(F.array_max(x).alias("best"), F.size(x).cast("long").alias("n"))

    rows = docs.select(F.col(id_col).alias("doc_id"), given(found, summed).alias("x"))
    return rows.select("doc_id", F.when(F.col("x.n") > 0, F.element_at(names, 1 - F.col("x.best.order"))).alias("license"), F.round(F.coalesce("x.best.dice", F.lit(0.0)), 6).alias("dice"), F.col("x.n").alias("n_hits"))


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_stretch() -> str:
    """_stretch() of the columns marks and rate, with places from 0."""
    start = "{'sum': 0.0::DOUBLE, 'at': 0::BIGINT, 'top': 0.0::DOUBLE, 's': 0::BIGINT, 'e': -1::BIGINT, 'i': 0::BIGINT, 'w': 0.0::DOUBLE}"
    each = "list_transform(marks, lambda m: {'sum': 0.0::DOUBLE, 'at': 0::BIGINT, 'top': 0.0::DOUBLE, 's': 0::BIGINT, 'e': -1::BIGINT, 'i': 0::BIGINT, 'w': (CASE WHEN m.again THEN 0.0 WHEN m.hit THEN 1.0 - rate ELSE -rate END)::DOUBLE})"
    total, at = "(CASE WHEN a.sum <= 0 THEN x.w ELSE a.sum + x.w END)", "(CASE WHEN a.sum <= 0 THEN a.i ELSE a.at END)"
    kept = ", ".join(f"'{c}': CASE WHEN {total} > a.top + 1e-9 THEN {new} ELSE a.{c} END" for c, new in (("top", total), ("s", at), ("e", "a.i")))
    return f"list_reduce(list_concat([{start}], {each}), lambda a, x: {{'sum': {total}, 'at': {at}, {kept}, 'i': a.i + 1, 'w': 0.0::DOUBLE}})"


_SQL_PART = "list_distinct(win[k.s + 1 : k.e + 1])"
_SQL_SHARED = f"len(list_intersect({_SQL_PART}, grams))"
_SQL_DICE = f"(2.0 * {_SQL_SHARED} / (len({_SQL_PART}) + b))::DOUBLE"

ORACLE = f"""
WITH t(template, license, length, b, more, grams) AS (
  VALUES {", ".join(f"({k}, {_quoted(name)}, {len(g)}, {len(set(g))}, {more_grams(g)}, [{', '.join(map(_quoted, dict.fromkeys(g)))}])" for k, (name, text) in enumerate(TEMPLATES) for g in [bigrams(text)])}
), x(gram, template, place) AS (
  VALUES {", ".join(f"({_quoted(g)}, {k}, {i})" for g, k, i in anchors_of(TEMPLATES))}
), w AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents
), g AS (
  SELECT r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w
), p AS (
  SELECT r, unnest(g) AS gram, generate_subscripts(g, 1) - 1 AS i FROM g
), c AS (
  SELECT DISTINCT r, template, i - place AS start FROM p JOIN x USING (gram)
), v AS (
  SELECT c.r, c.template, t.b, t.grams, greatest(c.start - t.more, 0) AS low, g.g[greatest(c.start - t.more, 0) + 1 : least(c.start + t.length + t.more, len(g.g))] AS win FROM c JOIN t USING (template) JOIN g USING (r)
), f AS (
  SELECT *, list_transform(win, lambda y, i: {{'hit': list_contains(grams, y), 'again': list_position(win, y) < i}}) AS marks, {THRESHOLD / 2}::DOUBLE AS rate FROM v
), f1 AS (SELECT *, {_sql_stretch()} AS k FROM f
), f2 AS (SELECT * EXCLUDE (rate, k), k.s AS s1, k.e AS e1, {_SQL_DICE} AS d1, {_SQL_SHARED} AS n1, {_SQL_DICE} / 2 AS rate FROM f1
), f3 AS (SELECT *, {_sql_stretch()} AS k FROM f2
), f4 AS (SELECT *, {_SQL_DICE} AS d2, {_SQL_SHARED} AS n2 FROM f3
), h AS (
  SELECT DISTINCT r, template, b, x.d AS dice, x.s AS s, x.e AS e, x.n AS shared
  FROM (SELECT r, template, b, greatest({{'d': d1, 's': low + s1, 'e': low + e1, 'n': n1}}, {{'d': d2, 's': low + k.s, 'e': low + k.e, 'n': n2}}) AS x FROM f4)
), m AS (
  SELECT r, count(*) AS n_hits FROM h WHERE dice >= {THRESHOLD} GROUP BY r
), k AS (
  SELECT r, template, dice FROM h WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r ORDER BY shared DESC, dice DESC, b DESC, template) = 1
)
SELECT g.doc_id, t.license, round(coalesce(k.dice, 0.0), 6)::DOUBLE AS dice, coalesce(m.n_hits, 0)::BIGINT AS n_hits
FROM g LEFT JOIN m USING (r) LEFT JOIN k USING (r) LEFT JOIN t USING (template)
"""

QUERIES = {"op3_license": op3_license}
ORACLES = {"op3_license": ORACLE}
