"""License notices found by MinHash bands over text windows, in DataFrame operations only.

Text and templates are lower-cased words (letters and digits), shingles are five words. A template of m words
has windows of m + s words every s words, s = m // 4 (1 at least), so each occurrence lies whole in
one window, and a window holds little else.

Templates of one length share their windows. A window's signature is taken over those of its shingles that
occur in a template of that length: no other can agree. If the share of a template's n shingles in the window
is `LEAST` or more, at least c = ceil(LEAST * n) are common, the window has at most m + s - 4, so the Jaccard
similarity is at least c / (m + s - 4 + n - c), whatever else stands in the window; 0.5 is about the least.
A band is one minimum, and there are as many as it takes to miss such a window with a probability of at most
`MISS` (1e-6): 20 for these templates. A window and a template that agree in a band are a candidate.

Candidates are verified: the share of the template's distinct shingles that occur in the window must
be `LEAST`.

Documents without anchor words are passed over first. For each template the anchors are the fewest
words such that more than 1 - LEAST of its shingles hold one of them, so no document with a match is
passed over.

Defined cases: null and empty texts match nothing; rows with one id and one text are one document, null ids
are an id like any other; templates need five words; only the key and the text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm.storage import materialise

SHINGLE = 5
LEAST = 0.8
MISS = 1e-6
WORD_GAP = r"[^\p{L}\p{N}]+"

# Notices as their licenses word them; fixed values.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT-short": "Released under the MIT License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def template_shingles(text: str) -> list[str]:
    words = template_words(text)
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def length_of(text: str) -> int:
    return len(template_words(text))


def step_of(length: int) -> int:
    """The windows' step for templates of `length` words; a window has `length` and a step more."""
    return max(1, length // 4)


def least_similarity(text: str) -> float:
    """The least Jaccard similarity of a template and a window that holds `LEAST` of its shingles."""
    m, n = length_of(text), len(template_shingles(text))
    common = math.ceil(LEAST * n - 1e-9)
    return common / (m + step_of(m) - SHINGLE + 1 + n - common)


def bands_for(templates: dict[str, str], miss: float = MISS) -> int:
    """One-row bands so that every template's match is missed with probability `miss` at most."""
    least = min(map(least_similarity, templates.values()))
    return 1 if least >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-least)))


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which every match of a template has one, preferring words already taken."""
    taken: list[str] = []
    for text in templates.values():
        shingles = [s.split() for s in template_shingles(text)]
        allowed = int((1 - LEAST) * len(shingles) + 1e-9)  # shingles that may be absent from a match
        left = [s for s in shingles if not set(s) & set(taken)]
        while len(shingles) - len(left) <= allowed:
            words = {w for s in left for w in s}
            best = max(sorted(words), key=lambda w: (sum(w in s for s in left) * len(w) ** 3, w))
            taken.append(best)
            left = [s for s in left if best not in s]
    return taken


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """Hashes of the five-word shingles in order; none for fewer words."""
    starts = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " ")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, stride, size, shingle): one row for each distinct shingle of a template."""
    rows = []
    for name, text in templates.items():
        shingles = template_shingles(text)
        if not shingles:
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        rows += [(name, length_of(text), len(shingles), s) for s in shingles]
    made = spark.createDataFrame(rows, "license string, length int, size int, words string")
    return made.select("license", "length", "size", F.xxhash64("words").alias("shingle"))


def banded(rows: DataFrame, keys: list[str], bands: int) -> DataFrame:
    """(keys, band): the MinHash of each group's shingles under each of `bands` seeds, marked by the seed."""
    mins = rows.groupBy(*keys).agg(*(F.min(F.xxhash64("shingle", F.lit(i))).alias(f"m{i}") for i in range(bands)))
    return mins.select(*keys, F.explode(F.array(*(F.xxhash64(F.lit(i), f"m{i}") for i in range(bands)))).alias("band"))


def windows_of(at: str, length: str) -> Column:
    """Numbers of the windows that hold the whole shingle at word `at`."""
    step = f"greatest(1, {length} div 4)"
    first = f"greatest(0, CAST(floor(({at} + {SHINGLE - 1} - {length}) / {step}) AS INT))"
    return F.expr(f"sequence({first}, CAST({at} div {step} AS INT))")


WINDOW = ["doc_id", "digest", "length", "window"]


def window_shingles(docs: DataFrame, templates: dict[str, str], key: str, text: str) -> DataFrame:
    """(doc_id, digest, length, window, shingle, at): the windows' distinct shingles known to templates of that length."""
    known = template_table(docs.sparkSession, templates).select("shingle", "length").distinct()
    # the same letters and edges as in words_of: for \b an underscore would be part of the word
    likely = r"(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, sorted(anchors(templates)))) + r")(?![\p{L}\p{N}])"
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text")).where(F.lower("text").rlike(likely))
    worded = rows.select("doc_id", "digest", words_of(F.col("text")).alias("words"))
    placed = worded.select("doc_id", "digest", F.posexplode(shingle_hashes(F.col("words"))).alias("at", "shingle"))
    hits = placed.join(F.broadcast(known), "shingle").select("doc_id", "digest", "length", F.explode(windows_of("at", "length")).alias("window"), "shingle", "at")
    return hits.groupBy(*WINDOW, "shingle").agg(F.min("at").alias("at"))


def candidates(hits: DataFrame, templates: dict[str, str]) -> DataFrame:
    """(doc_id, digest, length, window, license): what the bands retrieve."""
    bands = bands_for(templates)
    table = template_table(hits.sparkSession, templates)
    sought = banded(table, ["license", "length"], bands)
    return banded(hits, WINDOW, bands).join(F.broadcast(sought), ["length", "band"]).select(*WINDOW, "license").distinct()


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, first_word, n_windows, containment): one row for each document and license found.

    first_word is the place (from 0) of the first shingle of the license in the windows that match;
    containment is the highest of them. The templates are a parameter list, which bounds the broadcasts.
    """
    templates = TEMPLATES if templates is None else templates
    table = template_table(docs.sparkSession, templates)
    if not templates:
        raise ValueError("a scan needs templates")
    hits = materialise(window_shingles(docs, templates, key, text), "licenses")
    found = candidates(hits, templates).select(*(F.col(c).alias(f"_{c}") for c in WINDOW), F.col("license").alias("_license"))
    agreed = hits.join(F.broadcast(table), ["shingle", "length"]).groupBy(*WINDOW, "license", "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*WINDOW, "license")]  # an id may be null
    verified = agreed.join(found, same, "left_semi").where(F.col("n") >= F.lit(LEAST) * F.col("size") - 1e-9)
    return verified.groupBy("doc_id", "digest", "license").agg(
        F.min("at").cast("long").alias("first_word"), F.count(F.lit(1)).alias("n_windows"), F.max(F.col("n") / F.col("size")).alias("containment")
    ).drop("digest")
