"""Operator 8: license scan with DataFrame and SQL functions only.

A text becomes the sequence of its word shingles (three words, 64-bit hashes) and is
cut into windows of ``WINDOW`` shingles that overlap by half. The MinHash sketch of a
window keeps the smallest hash of each of 256 bins (one-permutation MinHash); each bin
is a band of one row. License templates are cut and sketched the same way, and equal
band keys retrieve a template for a window. In a window that holds a template's
shingles one of them is not the smallest of its bin with a probability of at most
``(WINDOW - 1) / (2 * 256)``, so a template of n shingles is missed with at most that
to the power n: 2e-4 for the shortest allowed (three shingles), less as it lies in two
windows.

Exact containment then verifies. An occurrence starts at one of the first shingles of the
template (as many as may be missing), so that the end of one notice and the head of the next
do not make a third; its span is the ``STRETCH`` fold of the template's length, as far as the last shingle of the template that is new in it.
At least ``MIN_CONTAINMENT`` of the template's distinct shingles and all shingles of its
required words (version, variant, third clause) must stand in the span. Where spans overlap,
first those of one template, then all, only the best counts: most shingles, then the shortest,
then the first, then the last template by name. So a GPL-2.0 notice isn't read as GPL-3.0, nor BSD-3-Clause as BSD-2-Clause.

Templates are a rule table. They are read by the driver in blocks of at most
``BLOCK_KEYS`` band keys (8 bytes each) that become literals of the plan, and every
block is held against every document. Nothing of a text is shuffled: only spans are
grouped. Three-word shingles are taken because whole notices may have five words.

Edge cases: null, empty and very short texts match nothing; templates with fewer than
``MIN_TEMPLATE_WORDS`` words are refused, as are required words that the template doesn't
have; spans are told apart by the row's text, so rows that share a doc_id (null included) are
one document in the result only; several matches of a license count once with the best
containment; only doc_id and text are read. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare

SHINGLE = 3
WINDOW = 32
STRIDE = 16
BIN_SHIFT = 56            # the upper 8 bits of a hash are its bin
MIN_TEMPLATE_WORDS = 5
MIN_CONTAINMENT = 0.8
BLOCK_KEYS = 100_000
#: An occurrence may be longer than its template by a quarter.
STRETCH = (5, 4)

#: Notices by which the licenses are commonly announced, short licenses as a
#: whole, and the words that tell a version or variant from its neighbours.
_BSD_HEAD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
             "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
             "distribution.")
_BSD_THIRD = (" 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
              "derived from this software without specific prior written permission.")
_BSD_TAIL = (" THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
             "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.")
_GNU_HEAD = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation"
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu affero general", "public license version 3")),
    ("AGPL-3.0", _GNU_HEAD.format(what="program", colon=":", kind="Affero General Public License") + ", either version 3 of the License, or (at your "
                 "option) any later version.", ("gnu affero general", "either version 3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license version 2 0",)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", ("apache license version 2 0",)),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL, ()),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL, ("neither the name", "endorse or promote")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("commons attribution 4 0",)),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("attribution noncommercial 4 0",)),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("attribution sharealike 4 0",)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public", "public license version 2")),
    ("GPL-2.0", _GNU_HEAD.format(what="program", colon=";", kind="General Public License") + "; either version 2 of the License, or (at your option) any "
                "later version.", ("gnu general public", "either version 2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public", "public license version 3")),
    ("GPL-3.0", _GNU_HEAD.format(what="program", colon=":", kind="General Public License") + ", either version 3 of the License, or (at your option) any "
                "later version.", ("gnu general public", "either version 3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies.", ("with or without fee",)),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", ("gnu lesser general", "public license version 2 1")),
    ("LGPL-2.1", _GNU_HEAD.format(what="library", colon=";", kind="Lesser General Public License") + "; either version 2.1 of the License, or (at your "
                 "option) any later version.", ("gnu lesser general", "either version 2 1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu lesser general", "public license version 3")),
    ("LGPL-3.0", _GNU_HEAD.format(what="library", colon=":", kind="Lesser General Public License") + ", either version 3 of the License, or (at your "
                 "option) any later version.", ("gnu lesser general", "either version 3")),
    ("MIT", "Released under the MIT License.", ("the mit license",)),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", ("free of charge",)),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("public license v 2 0",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, "
                  "or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
                  "non-commercial, and by any means.", ("free and unencumbered software",)),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
             "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
             "applications, and to alter it and redistribute it freely, subject to the following restrictions", ("alter it and redistribute",)),
)

WORD_GAP = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def known_templates(spark: SparkSession) -> DataFrame:
    """``(template, license, text, required)``: the table that ``scan`` takes; ``required`` (an array of
    phrases of at least three words) may be null."""
    rows = [(f"{name}#{i:02d}", name, text, list(must)) for i, (name, text, must) in enumerate(TEMPLATES)]
    return spark.createDataFrame(rows, "template string, license string, text string, required array<string>")


def shingles(words: Column) -> Column:
    """Hashes of the runs of three words, in order."""
    n = F.size(words)
    return F.when(n >= SHINGLE, F.transform(
        F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    ).otherwise(F.array().cast("array<bigint>"))


def window_keys(h: Column) -> Column:
    """Per window the smallest hash of each bin (array of arrays)."""
    last = F.ceil(F.greatest(F.size(h) - WINDOW, F.lit(0)) / STRIDE).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda j: F.sort_array(F.slice(h, j * STRIDE + 1, WINDOW)))
    return F.transform(windows, lambda s: F.filter(
        s, lambda x, i: (i == 0) | (F.shiftright(x, BIN_SHIFT) != F.shiftright(F.get(s, F.greatest(i - 1, F.lit(0))), BIN_SHIFT))))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def sketched(rows: DataFrame, *ids: str) -> DataFrame:
    """``ids`` with ``h`` (shingles) and ``keys`` (band keys per window); each step is a
    projection of its own, as the next one reads its result several times."""
    words = rows.select(*ids, words_of(F.col("text")).alias("words"))
    h = words.select(*ids, shingles(F.col("words")).alias("h"))
    return h.select(*ids, "h", window_keys(F.col("h")).alias("keys"))


def _blocks(templates: DataFrame):
    """Lists of (template, license, shingles, keys, required shingles) with at most BLOCK_KEYS keys (or one template)."""
    known = templates.where("template IS NOT NULL AND license IS NOT NULL")
    required = F.col("required") if "required" in templates.columns else F.array().cast("array<string>")
    must = known.select("template", F.flatten(F.transform(F.coalesce(required, F.array().cast("array<string>")),
                                                         lambda x: shingles(words_of(x)))).alias("must"))
    rows = sketched(known, "template", "license").join(must, "template").select(
        "template", "license", F.array_distinct("h").alias("h"), F.array_distinct(F.flatten("keys")).alias("keys"), F.array_distinct("must").alias("must"))
    block, size = [], 0
    for r in rows.orderBy("template").toLocalIterator():
        if len(r["h"]) < MIN_TEMPLATE_WORDS - SHINGLE + 1:
            raise ValueError(f"template {r['template']} has fewer than {MIN_TEMPLATE_WORDS} words")
        if not set(r["must"]) <= set(r["h"]):
            raise ValueError(f"template {r['template']} does not have its required words")
        if block and size + len(r["keys"]) > BLOCK_KEYS:
            yield block
            block, size = [], 0
        block.append((r["template"], r["license"], r["h"], r["keys"], r["must"]))
        size += len(r["keys"])
    if block:
        yield block


def spans(docs: DataFrame, templates: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``(doc_id, x1, x2, template, license, start, end, k, n)`` of every verified occurrence; x1 and x2
    stand for the row's text, start and end are shingle positions, k of the template's n
    distinct shingles were found."""
    prepare(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("x1"), F.xxhash64(F.lit(7), "text").alias("x2"))
    ids = ["doc_id", "x1", "x2"]
    base = sketched(src, *ids)
    out = None
    for block in _blocks(templates):
        every = F.lit(sorted({k for _, _, _, keys, _ in block for k in keys})).cast("array<bigint>")
        longs = lambda a: F.lit(a).cast("array<bigint>")
        table = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(name).alias("license"), longs(h).alias("h"), longs(keys).alias("keys"),
                                   longs(must).alias("must"), longs([x for i, x in enumerate(h) if (len(h) - i) / len(h) >= min_containment]).alias("heads"), F.lit(-(-len(h) * STRETCH[0] // STRETCH[1])).alias("most"))
                          for t, name, h, keys, must in block])
        hit = base.select(*ids, "h", "keys", F.array_intersect(F.flatten("keys"), every).alias("hit"))
        # explode_outer: an inferred filter would compute the sketches a second time
        hit = hit.select(*ids, "h", "keys", F.explode_outer(F.when(F.size("hit") > 0, F.filter(
            table, lambda t: F.arrays_overlap(t["keys"], F.col("hit"))))).alias("t")).where("t IS NOT NULL")
        window = hit.select(*ids, "h", "t", F.explode_outer(F.filter(
            F.sequence(F.lit(0), F.size("keys") - 1), lambda j: F.arrays_overlap(F.get(F.col("keys"), j), F.col("t")["keys"]))
        ).alias("window")).where("window IS NOT NULL")
        size, most = F.size("t.h"), F.col("t.most")
        first = F.greatest(F.col("window") * STRIDE - most, F.lit(0))
        last = F.least(F.col("window") * STRIDE + WINDOW + most, F.size("h")) - 1
        region = F.slice("h", first + 1, last + most - first + 1)
        near = window.select("*", (F.size(F.array_intersect(region, F.col("t.h"))) / size).alias("c")).where(F.col("c") >= min_containment)
        starts = F.filter(F.sequence(first, last), lambda p: F.array_contains(F.col("t")["heads"], F.get(F.col("h"), p)))
        at = near.select(*ids, "h", "t", F.explode_outer(starts).alias("start")).where("start IS NOT NULL").distinct()
        here = F.slice("h", F.col("start") + 1, most)
        found = at.select(*ids, "t", "start", here.alias("here"), F.array_intersect(here, F.col("t.h")).alias("same"))
        found = found.where((F.size("same") / size >= min_containment) & (F.size(F.array_except("t.must", "same")) == 0))
        # The span ends with the last shingle of the template that is new in it.
        end = F.col("start") + F.array_position("here", F.element_at("same", -1)) - 1
        found = found.select(*ids, "t.template", "t.license", "start", end.cast("int").alias("end"), F.size("same").alias("k"), size.alias("n"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame(
            [], "doc_id long, x1 long, x2 long, template string, license string, start int, end int, k int, n int")
    return out.distinct()


def matches(docs: DataFrame, templates: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``(doc_id, template, license, start, end, containment)``: the occurrences that are the best
    wherever they overlap others."""
    s = spans(docs, templates, min_containment)
    row = ["doc_id", "x1", "x2"]
    span = [*row, "template", "license", "start", "end", "k", "n"]

    def best(s: DataFrame, *within: str) -> DataFrame:
        """The spans that are the best at all of their positions."""
        at = s.select(*span, F.explode(F.sequence("start", "end")).alias("q"))
        order = [F.desc("k"), F.expr("end - start"), F.col("start"), F.desc("template")]
        r = F.row_number().over(Window.partitionBy(*within, "q").orderBy(*order))
        return at.withColumn("r", r).groupBy(*span).agg(F.max("r").alias("r")).where("r = 1").drop("r")

    # First among the spans of one template, of which long ones may reach into the neighbour.
    kept = best(best(s, *row, "template"), *row)
    return kept.select("doc_id", "template", "license", "start", "end", (F.col("k") / F.col("n")).alias("containment"))


def scan(docs: DataFrame, templates: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """Per document and license found: doc_id, license, containment (the best)."""
    return (matches(docs, templates, min_containment).groupBy("doc_id", "license")
            .agg(F.round(F.max("containment"), 6).alias("containment")))


def oracle_sql() -> str:
    """DuckDB SQL for ``scan`` over ``documents`` with the known templates: every shingle of
    a template is tried as a start, without retrieval (one row per doc_id)."""
    def q(x):
        return "'" + x.replace("'", "''") + "'"

    quoted = ", ".join(f"({q(f'{name}#{i:02d}')}, {q(name)}, {q(text)}, [{', '.join(map(q, must))}]::VARCHAR[])"
                       for i, (name, text, must) in enumerate(TEMPLATES))
    gap = WORD_GAP
    return f"""
WITH t0(template, license, text, required) AS (VALUES {quoted}),
tw AS (SELECT template, license, list_filter(string_split_regex(lower(text), '{gap}'), lambda x: x != '') AS w FROM t0),
ts AS (SELECT template, license, g, row_number() OVER (PARTITION BY template ORDER BY min(i)) - 1 AS idx FROM (
       SELECT template, license, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM tw)) GROUP BY template, license, g),
mw AS (SELECT template, string_split(m, ' ') AS w FROM (SELECT template, unnest(required) AS m FROM t0)),
ms AS (SELECT DISTINCT template, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM mw)),
mn AS (SELECT template, count(*) AS musts FROM ms GROUP BY template),
tn AS (SELECT template, count(*) AS n, CAST(ceil(count(*) * {STRETCH[0]} / {STRETCH[1]}.0) AS BIGINT) AS most FROM ts GROUP BY template),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{gap}'), lambda x: x != '') AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS p, array_to_string(list_slice(w, i, i + 2), ' ') AS g
       FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
m AS (SELECT doc_id, template, license, p, g, idx, ms.g IS NOT NULL AS must FROM ds JOIN ts USING (g) LEFT JOIN ms USING (template, g)),
f AS (SELECT a.doc_id, a.template, a.license, a.p AS s, n, b.g, b.must, min(b.p) AS p
      FROM m a JOIN tn USING (template) JOIN m b ON b.doc_id = a.doc_id AND b.template = a.template AND b.p >= a.p AND b.p < a.p + most
      WHERE (n - a.idx) / n >= {MIN_CONTAINMENT} GROUP BY ALL),
s AS (SELECT doc_id, template, license, s, n, max(p) AS e, count(*) AS k, count(*) FILTER (must) AS had FROM f GROUP BY ALL),
o AS (SELECT s.* FROM s LEFT JOIN mn USING (template) WHERE k / n >= {MIN_CONTAINMENT} AND had = coalesce(musts, 0)),
q AS (SELECT *, unnest(range(s, e + 1)) AS q FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template, q ORDER BY k DESC, e - s, s) AS r FROM q),
o2 AS (SELECT doc_id, template, license, s, e, k, n FROM r GROUP BY ALL HAVING max(r) = 1),
q2 AS (SELECT *, unnest(range(s, e + 1)) AS q FROM o2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, q ORDER BY k DESC, e - s, s, template DESC) AS r FROM q2),
b AS (SELECT doc_id, license, k, n FROM r2 GROUP BY doc_id, template, license, s, e, k, n HAVING max(r) = 1)
SELECT doc_id, license, round(max(k / n), 6) AS containment FROM b GROUP BY doc_id, license"""
