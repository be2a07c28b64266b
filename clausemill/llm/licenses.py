r"""License scans: MinHash over overlapping text windows retrieves templates, exact shingle
containment verifies them.  DataFrame functions only.

Words are ``[a-z0-9]+`` of the lower-cased text, shingles five words.  Templates are put
into classes by their number of shingles, each class at most 1.25 times as wide as the
next.  For a class of c shingles, windows hold c + h shingles and start every h = c/2, so a
template's place lies wholly inside a window.  A match of containment 0.8 or more then has
a Jaccard similarity of at least 0.8 * 0.8 / (1.5 + 0.16) = 0.385 with its window, and 24 bands
of one MinHash value meet with probability 1 - (1 - 0.385)^24 > 0.99999.

Before that, a document is dropped only if no template can match: for each template the
longest words are chosen until shingles without any of them are fewer than the threshold
asks for; a document with none of these words cannot hold 80 % of the shingles.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT = 5, 0.8
#: The most that the chance of a match that meets its template in no band may be.
MISSED = 1e-5
WORD = re.compile(r"[a-z0-9]+")
#: Notices that are looked for: name and text.
TEMPLATES = {
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def shingle_set(text: str) -> set[str]:
    """The five-word shingles of a template; with fewer words, the whole sequence as one."""
    w = WORD.findall(text.lower())
    return {" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def size_class(shingles: int) -> int:
    c = 1
    while c < shingles:
        c = max(c + 1, int(c * 1.25))
    return c


def band_count(threshold: float = CONTAINMENT) -> int:
    """Bands of one value each such that a match is missed with a chance of MISSED at most: 24 at 0.8."""
    similar = threshold * 0.8 / (1.5 + 0.8 - 0.8 * threshold)
    return math.ceil(math.log(MISSED) / math.log(1 - similar)) if 0 < similar < 1 else 1


def needed_words(templates: dict[str, str], threshold: float = CONTAINMENT) -> list[str]:
    """Words of which a document must have at least one to hold ``threshold`` of any template."""
    out: set[str] = set()
    for text in templates.values():
        left = shingle_set(text)
        least = math.ceil(threshold * len(left) - 1e-9)
        for word in sorted({w for s in left for w in s.split()}, key=lambda w: (w not in out, -len(w), w)):
            if len(left) < least:
                break
            out.add(word)
            left = {s for s in left if word not in s.split()}
    return sorted(out)


def _shingle(words: Column, place: Column) -> Column:
    """The shingle of a place, counted from 1."""
    return F.array_join(F.slice(words, place, SHINGLE), " ")


def _signature(shingles: Column, bands: int) -> Column:
    """The MinHash values of an array of shingles, one for each band."""

    def least(k):
        return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*(least(k) for k in range(bands)))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(license, size, width, known): a template's shingles and the class it belongs to."""
    rows = [(name, len(s), size_class(len(s)), sorted(s)) for name, text in templates.items() if (s := shingle_set(text))]
    return spark.createDataFrame(rows, "license string, size int, width int, known array<string>")


def band_shingles(known: DataFrame, bands: int) -> list[int]:
    """Hashes of the shingles that give a template the value of some band."""

    def least(k):
        return F.array_min(F.transform("known", lambda x: F.struct(F.xxhash64(x, F.lit(k)), F.xxhash64(x).alias("h"))))["h"]

    rows = known.select(F.explode(F.array_distinct(F.array(*(least(k) for k in range(bands))))).alias("h")).distinct()
    return sorted(r.h for r in rows.collect())  # at most a shingle for each template and band


def scan_licenses(documents: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """(doc_id, license, containment, first_word): each template of which at least
    ``threshold`` of the shingles lie in one window of the document, with the best window's
    share and the place of its first word; a row for each pair of document and template.

    A window whose value in a band is that of a template holds the shingle that gives the
    template this value.  So signatures are computed of the windows that hold such a shingle;
    no other window can meet a template in any band.  All that happens beside the document's
    row; the best matches alone are shuffled.

    Null and empty texts and null ids match nothing; repeated rows give one result; other
    columns are ignored; no templates give an empty result.
    """
    spark = documents.sparkSession
    known = template_table(spark, templates)  # templates are code: one row each
    widths = sorted({size_class(len(s)) for t in templates.values() if (s := shingle_set(t))}) or [1]
    steps = [max(1, w // 2) for w in widths]
    lower = F.lower(F.col("text").cast("string"))
    needed, n_bands = needed_words(templates, threshold) or ["\0"], band_count(threshold)
    docs = documents.filter("doc_id IS NOT NULL").select("doc_id", lower.alias("t")).filter(F.col("t").rlike("|".join(needed)))
    docs = docs.select("doc_id", F.filter(F.split("t", "[^a-z0-9]+", -1), lambda w: w != "").alias("words"))

    words = F.col("words")
    places = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    marks = band_shingles(known, n_bands)
    marked = F.filter(F.sequence(F.lit(1), places), lambda i: F.xxhash64(_shingle(words, i)).isin(marks))

    def around(i):
        """Numbers of the windows of all classes that hold place i: window * classes + class."""

        def of_class(k, width, step):
            first = F.greatest(F.lit(0), F.ceil((i - width - step) / step).cast("int"))
            last = F.floor((i - 1) / step).cast("int")
            return F.transform(F.sequence(first, last), lambda w: w.cast("long") * len(widths) + k)

        return F.concat(*(of_class(k, *x) for k, x in enumerate(zip(widths, steps))))

    def cut(number):
        k = (number % len(widths)).cast("int") + 1
        width, step = (F.element_at(F.array(*map(F.lit, x)), k) for x in (widths, steps))
        begin = (F.floor(number / len(widths)) * step).cast("int")  # from 0
        end = F.least(begin + width + step, places)
        return F.struct(width.alias("width"), begin.alias("begin"), F.transform(F.sequence(begin + 1, end), lambda i: _shingle(words, i)).alias("held"))

    numbers = F.array_distinct(F.flatten(F.transform(marked, around)))
    windows = docs.select("doc_id", F.inline(F.transform(numbers, cut)))
    bands = windows.select("doc_id", "begin", "width", "held", F.posexplode(_signature(F.col("held"), n_bands)).alias("band", "value"))
    signs = known.select("license", "size", "width", "known", F.posexplode(_signature(F.col("known"), n_bands)).alias("band", "value"))
    found = bands.join(F.broadcast(signs), ["width", "band", "value"])  # a row for each template and band
    inside = F.filter(F.sequence(F.lit(0), F.size("held") - 1), lambda i: F.array_contains("known", F.get("held", i)))
    verified = found.select(
        "doc_id", "license", (F.size(F.array_intersect("held", "known")) / F.col("size")).alias("containment"), (F.col("begin") + F.array_min(inside)).alias("first_word")
    ).filter(F.col("containment") >= threshold - 1e-9)
    best = F.max_by(F.struct("containment", "first_word"), F.struct("containment", -F.col("first_word"))).alias("best")
    return verified.groupBy("doc_id", "license").agg(best).select("doc_id", "license", "best.*")


def oracle_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The result by plain comparison of every window, for DuckDB."""
    rows = ", ".join(f"('{name}', {len(s)}, {size_class(len(s))}, '{x}')" for name, text in templates.items() if (s := shingle_set(text)) for x in sorted(s))
    return f"""
WITH known(license, size, width, shingle) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(generate_series(0, greatest(len(w) - 5, 0))) AS place FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, place, array_to_string(w[place + 1 : place + 5], ' ') AS shingle FROM p),
m AS (SELECT doc_id, place, license, size, width, greatest(1, width // 2) AS step, shingle FROM s JOIN known USING (shingle)),
x AS (SELECT *, unnest(generate_series(greatest(0, CAST(ceil((place - width - step + 1) / step) AS BIGINT)), place // step)) AS win FROM m),
c AS (SELECT doc_id, license, count(DISTINCT shingle) / max(size) AS containment, min(place) AS first_word FROM x GROUP BY doc_id, license, win)
SELECT doc_id, license, max(containment) AS containment, CAST(arg_max(first_word, containment * 1e9 - first_word) AS INTEGER) AS first_word
FROM c WHERE containment >= {CONTAINMENT} - 1e-9 GROUP BY doc_id, license
"""
