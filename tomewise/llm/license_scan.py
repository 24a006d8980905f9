"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

A text's 5-word shingles are cut into windows of WINDOW shingles, one every STRIDE, so every run of
WINDOW - STRIDE + 1 shingles lies whole in some window. A window's sketch is a one-permutation MinHash: the hash space
has BINS bins, and the least hash of each is a band of one row. Templates are cut in the same way, one window a
shingle. One row a band, as a notice of one sentence has only a few shingles of a window, and a second row would lose
it. A window that holds a shingle of a template whole shares its band unless a foreign shingle stands below it in its
bin: (WINDOW - 1) / (2 BINS) or less, 1.4 per cent. A template whose shingles are in the text to NUM / DEN is lost only
if that happens to each of them in each of its windows; `miss` bounds that, and only templates of one or two shingles
come near the 1.4 per cent squared that two windows leave. Retrieved templates are kept where at least 0.75 of their
distinct shingles occur in the text, compared as strings.

DataFrame operations only, without a shuffle; the templates are literals of a fixed number.

Defined results: null, empty or short texts hold no license; a document with several licenses has a row for each; rows
that repeat a doc_id, a null one too, are answered row by row; no text is cut short; columns besides doc_id and text
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
WINDOW, STRIDE = 8, 4
BINS_LOG2 = 8
NUM, DEN = 75, 100

# License notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-notice", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    (
        "MIT-permission",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-disclaimer",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    ("BSD-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

#: ASCII characters that stand between words.
BETWEEN = r"[\x00-/:-`{-\x7f]+"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, BETWEEN), lambda w: w != "")


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column computed once a row: a generator keeps the optimizer from repeating it inside lambdas."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_bands(df: DataFrame, stride: int) -> DataFrame:
    """df, which has words w, with the bands of all windows of its shingles."""
    last = f"size(w) - {SHINGLE}"
    hashes = f"if(size(w) < {SHINGLE}, array(), transform(sequence(0, {last}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(SHINGLE))})))"
    df = computed(df, "h", F.expr(hashes))
    windows = f"if(size(h) = 0, array(), transform(sequence(1, size(h), {stride}), k -> array_sort(slice(h, k, {WINDOW}))))"
    df = computed(df, "sorted", F.expr(windows))
    bin_of = f"shiftright({{}}, {64 - BINS_LOG2})"
    least = f"transform(sorted, s -> filter(s, (x, i) -> i = 0 or {bin_of.format('x')} <> {bin_of.format('s[greatest(i - 1, 0)]')}))"
    return computed(df, "bands", F.expr(f"flatten({least})")).drop("sorted", "h")


def shingles(w: str) -> str:
    return f"array_distinct(if(size({w}) < {SHINGLE}, cast(array() as array<string>), transform(sequence(1, size({w}) - {SHINGLE - 1}), i -> concat_ws(' ', slice({w}, i, {SHINGLE})))))"


def miss(n: int) -> float:
    """A bound of the chance that a text with all n shingles of a template shares no band with it: each is hidden in both of its windows."""
    return ((WINDOW - 1) / (2 << BINS_LOG2)) ** (2 * n)


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, license, n_shingles (of the template), n_found and containment of each document and license it holds."""
    spark = docs.sparkSession
    kinds = computed(spark.createDataFrame(list(templates), "license string, notice string"), "w", words(F.col("notice")))
    kinds = with_bands(kinds, 1).withColumn("s", F.expr(shingles("w"))).where("size(s) > 0")
    told = kinds.select("license", "s", F.array_distinct("bands").alias("bands")).collect()  # of the templates only
    of_band: dict[int, list[str]] = {}
    for r in sorted(told):
        for band in r.bands:
            of_band.setdefault(band, []).append(r.license)
    licenses = F.create_map(*(x for band, names in sorted(of_band.items()) for x in (F.lit(band), F.array(*map(F.lit, names)))))
    of_license = spark.createDataFrame(sorted({(r.license, tuple(r.s)) for r in told}), "license string, s array<string>")

    texts = computed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "w", words(F.col("text"))).drop("text")
    hits = computed(with_bands(texts, STRIDE), "hit", F.array_distinct(F.filter("bands", lambda b: b.isin(sorted(of_band))))).where("size(hit) > 0")
    hits = computed(hits.select("doc_id", "w", "hit"), "own", F.expr(shingles("w")))
    hits = hits.select("doc_id", "own", F.explode(F.array_distinct(F.flatten(F.transform("hit", lambda b: licenses[b])))).alias("license"))
    found = hits.join(F.broadcast(of_license), "license")
    found = found.select("doc_id", "license", F.size("s").cast("long").alias("n_shingles"), F.size(F.array_intersect("own", "s")).cast("long").alias("n_found"))
    return found.where(f"{DEN} * n_found >= {NUM} * n_shingles").withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def oracle(table: str = "documents", templates=TEMPLATES) -> str:
    """The same rows by exact containment alone, in DuckDB's SQL."""
    given = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in templates)
    between = r"[\x00-/:-`{-\x7f]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    split = lambda c: f"list_filter(regexp_split_to_array({lower.format(c)}, '{between}'), lambda x: x <> '')"
    cut = f"list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))"
    return f"""
    WITH t(license, notice) AS (VALUES {given}),
    ts AS (SELECT license, {cut} AS s FROM (SELECT license, {split('notice')} AS w FROM t)),
    te AS (SELECT license, len(s) AS n_shingles, unnest(s) AS sh FROM ts),
    ds AS (SELECT row, doc_id, unnest({cut}) AS sh FROM (SELECT row_number() OVER () AS row, doc_id, {split("coalesce(text, '')")} AS w FROM {table})),
    hit AS (SELECT row, doc_id, te.license, te.n_shingles, ds.sh FROM ds JOIN te ON ds.sh = te.sh)
    SELECT doc_id, license, CAST(n_shingles AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_found,
           count(*)::DOUBLE / n_shingles AS containment
    FROM hit GROUP BY row, doc_id, license, n_shingles HAVING {DEN} * count(*) >= {NUM} * n_shingles"""
