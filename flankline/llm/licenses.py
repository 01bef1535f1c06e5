"""Licence scan in DataFrame operations: passages and windows against templates by Dice over word bigrams.

A text is lower-cased, everything but a-z, 0-9 and line ends becomes one space, and its passages are its lines
and its paragraphs (parted by blank lines, their lines joined). A passage with a distinct bigrams and a
template with b share c; Dice is ``2c / (a + b)``. At a threshold t only templates with
``a * t / (2 - t) <= b <= a * (2 - t) / t`` can match: these bounds prune the candidates before any
comparison. Before that, passages drop out that hold none of a template's pivotal words, chosen so that a
match without any of them is impossible.

A notice within a longer line, or across paragraphs, is found by windows: wherever the words of the whole text
have one of a template's anchor bigrams, a window of the template's number of words is laid so that the bigram
stands where the template has it. Anchors are chosen so that a window without any cannot match; windows are cut
at the ends of the text, and too short ones are pruned by the same bounds.

Defined results: a null, empty or unmatched text gives no row; a licence is reported once for each id with its
best Dice, the number of distinct passages that match and the number of places where a matching window begins;
rows that repeat an id count as one document; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

# fixed values: wording of public licence notices
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# end of fixed values
#: A tag names its licence: one more template for each.
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in sorted({name for name, _ in TEMPLATES} - {"proprietary"})]
THRESHOLD = 0.8


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def in_order(text: str) -> list[str]:
    words = words_of(text)
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def bigrams(text: str) -> set[str]:
    return set(in_order(text))


def bounds(b: int, threshold: float) -> tuple[int, int]:
    """How many distinct bigrams a passage may have to match a template of ``b``."""
    return ceil(b * threshold / (2 - threshold) - 1e-9), floor(b * (2 - threshold) / threshold + 1e-9)


def pivotal(grams: set[str], threshold: float) -> list[str]:
    """Words without which a passage cannot share enough bigrams: taking theirs away leaves too few. Long words first."""
    need = ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
    left, out = set(grams), []
    while len(left) >= need:
        words = sorted({w for g in left for w in g.split()})
        best = max(words, key=lambda w: (min(len(w), 7), sum(w in g.split() for g in left), w))
        out.append(best)
        left = {g for g in left if best not in g.split()}
    return out


def anchors(text: str, threshold: float) -> list[tuple[str, int]]:
    """(bigram, its place) for the bigrams of which a window that matches has one: all but one fewer than it must share. Long words first."""
    grams = bigrams(text)
    spared = ceil(len(grams) * threshold / (2 - threshold) - 1e-9) - 1
    chosen = set(sorted(grams, key=lambda g: (-min(map(len, g.split())), -len(g), g))[: len(grams) - spared])
    return [(g, k) for k, g in enumerate(in_order(text)) if g in chosen]


def plain_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\n]+", " ")


def passages(plain: Column) -> Column:
    paragraphs = F.transform(F.split(plain, r"\n *\n[ \n]*"), lambda p: F.regexp_replace(p, r" *\n *", " "))
    return F.array_distinct(F.transform(F.concat(F.split(plain, "\n"), paragraphs), lambda x: F.trim(x)))


def literal(items: list[str]) -> Column:
    """A constant array, folded from one string: a call for each item takes seconds."""
    return F.split(F.lit("\n".join(items)), "\n")


def grams_of(words: Column) -> Column:
    """The distinct bigrams of two words or more."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value evaluated once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), use), 0)


def whole_matches(words: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Matches of a passage taken as a whole."""

    def against(grams: Column) -> Column:
        tests = []
        for name, body in templates:
            g = sorted(bigrams(body))
            lo, hi = bounds(len(g), threshold)
            dice = 2.0 * F.size(F.array_intersect(grams, literal(g))) / (F.size(grams) + len(g))
            tests.append(F.when(F.size(grams).between(lo, hi), F.struct(F.lit(name).alias("license"), dice.alias("dice"), F.lit(None).cast("long").alias("start"))))
        return F.filter(F.array(*tests), lambda m: m["dice"] >= threshold)

    return bound(grams_of(words), against)


def window_matches(words: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Matches of windows within a text. A candidate is one number, ``(start + longest) * len(templates) + template``."""
    many, longest = len(templates), max(len(words_of(body)) for _, body in templates)
    places: dict[str, list[int]] = {}
    for t, (_, body) in enumerate(templates):
        for g, k in anchors(body, threshold):
            places.setdefault(g, []).append((longest - k) * many + t)
    shifts = F.str_to_map(F.lit("\n".join(f"{g}:{','.join(map(str, v))}" for g, v in sorted(places.items()))), F.lit("\n"), F.lit(":"))
    names = literal([name for name, _ in templates])
    lengths = literal([str(len(words_of(body))) for _, body in templates]).cast("array<int>")
    least = literal([str(bounds(len(bigrams(body)), threshold)[0]) for _, body in templates]).cast("array<int>")
    known = literal([",".join(sorted(bigrams(body))) for _, body in templates])

    pairs = F.transform(words, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1)).alias("g"), i.cast("long").alias("i")))
    hits = F.filter(pairs, lambda p: p["g"].isin(sorted(places)))
    codes = F.array_distinct(F.flatten(F.transform(hits, lambda p: F.transform(F.split(shifts[p["g"]], ",").cast("array<long>"), lambda n: p["i"] * many + n))))
    spans = F.transform(
        codes,
        lambda c: F.struct(
            (c % many).cast("int").alias("t"),
            F.greatest(F.floor(c / many) - longest, F.lit(0)).cast("int").alias("start"),
            F.least(F.floor(c / many) - longest + F.get(lengths, (c % many).cast("int")), F.size(words)).cast("int").alias("stop"),
        ),
    )
    spans = F.filter(spans, lambda s: s["stop"] - s["start"] > F.get(least, s["t"]))

    def judged(s: Column) -> Column:
        grams = grams_of(F.slice(words, s["start"] + 1, s["stop"] - s["start"]))
        both = F.struct(grams.alias("a"), F.split(F.get(known, s["t"]), ",").alias("b"))
        dice = bound(both, lambda x: 2.0 * F.size(F.array_intersect(x["a"], x["b"])) / (F.size(x["a"]) + F.size(x["b"])))
        return F.struct(F.get(names, s["t"]).alias("license"), dice.alias("dice"), s["start"].cast("long").alias("start"))

    return F.filter(F.transform(spans, judged), lambda m: m["dice"] >= threshold)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, dice, passages, windows) for every licence that a passage or window of a document matches.

    Texts, then passages, without a pivotal word go first; what is left is little. Words and bigrams are bound once,
    as the variables of lambda functions: a column would be evaluated again wherever the optimiser copies it to.
    """
    pivots = literal(sorted({w for _, body in templates for w in pivotal(bigrams(body), threshold)}))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), plain_text(F.col(text)).alias("plain"))
    texts = texts.where(F.arrays_overlap(F.split("plain", "[ \n]"), pivots))
    parts = F.transform(passages(F.col("plain")), lambda x: F.struct(F.lit(False).alias("windows"), x.alias("passage")))
    whole = F.struct(F.lit(True).alias("windows"), F.trim(F.regexp_replace("plain", "[ \n]+", " ")).alias("passage"))
    lines = texts.select("id", F.inline(F.concat(parts, F.array(whole)))).where(F.arrays_overlap(F.split("passage", " "), pivots))

    def matches(words: Column) -> Column:
        return F.when(F.size(words) < 2, F.array()).when(F.col("windows"), window_matches(words, templates, threshold)).otherwise(whole_matches(words, templates, threshold))

    found = lines.select("id", F.when(~F.col("windows"), F.col("passage")).alias("passage"), F.inline(bound(F.split("passage", " "), matches)))
    return found.groupBy(F.col("id").alias(id_col), "license").agg(F.max("dice").alias("dice"), F.count_distinct("passage").alias("passages"), F.count_distinct("start").alias("windows"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("dice", F.round("dice", 6))


def _sql() -> str:
    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def shared(a: str) -> str:
        return f"2.0::DOUBLE * len(list_intersect({a}, b)) / (len({a}) + len(b))"

    def grams(words: str) -> str:
        return f"list_distinct(list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]))"

    rows = ",\n    ".join(f"({t}, {quote(name)}, {len(words_of(body))}, [{', '.join(map(quote, sorted(bigrams(body))))}])" for t, (name, body) in enumerate(TEMPLATES))
    places = ", ".join(f"({t}, {quote(g)}, {k})" for t, (_, body) in enumerate(TEMPLATES) for g, k in anchors(body, THRESHOLD))
    return rf"""
WITH t(t, license, n, b) AS (
  VALUES
    {rows}
), anchor(t, gram, place) AS (
  VALUES {places}
), d AS (
  SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9\n]+', ' ', 'g') AS plain FROM documents WHERE text IS NOT NULL
), p AS (
  SELECT doc_id, unnest(string_split(plain, chr(10))) AS passage FROM d
  UNION ALL
  SELECT doc_id, replace(unnest(string_split_regex(plain, '\n *\n[ \n]*')), chr(10), ' ') FROM d
), w AS (
  SELECT DISTINCT doc_id, trim(regexp_replace(passage, ' +', ' ', 'g')) AS passage, string_split(trim(regexp_replace(passage, ' +', ' ', 'g')), ' ') AS words FROM p
), g AS (
  SELECT doc_id, passage, {grams("words")} AS a FROM w WHERE len(words) > 1
), whole AS (
  SELECT doc_id, license, passage, NULL AS start, {shared("a")} AS dice
  FROM g JOIN t ON len(a) <= len(b) * 1.5 + 1e-9 AND len(b) <= len(a) * 1.5 + 1e-9
), x AS (
  SELECT row_number() OVER () AS row_id, doc_id, string_split(trim(regexp_replace(plain, '[ \n]+', ' ', 'g')), ' ') AS words FROM d
), y AS (
  SELECT row_id, unnest(range(len(words) - 1)) AS i, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram FROM x
), z AS (
  SELECT DISTINCT row_id, t, i - place AS start FROM y JOIN anchor USING (gram)
), win AS (
  SELECT doc_id, license, b, greatest(start, 0) AS start, words[greatest(start, 0) + 1 : start + n] AS part FROM z JOIN t USING (t) JOIN x USING (row_id)
), windows AS (
  SELECT doc_id, license, start, b, {grams("part")} AS a FROM win WHERE len(part) > 1
), m AS (
  SELECT doc_id, license, passage, start, dice FROM whole
  UNION ALL
  SELECT doc_id, license, NULL, start, {shared("a")} FROM windows
)
SELECT doc_id, license, round(max(dice), 6) AS dice, count(DISTINCT passage) AS passages, count(DISTINCT start) AS windows
FROM m WHERE dice >= {THRESHOLD} GROUP BY doc_id, license
"""


SQL = _sql()
