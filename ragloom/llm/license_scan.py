"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Main path in DataFrame functions only. Words are runs of letters and digits, A-Z in lower case; shingles are five
words. Texts are cut into blocks of STRIDE shingles; a window is a block and the next one, so windows of WINDOW
shingles overlap by half. Templates are covered by windows at every place. A window has 2 * len(MASKS) bands: the least
and the greatest of its shingle hashes, and the same after flipping the bits of a mask, by which the hashes are ordered
anew. A text's window that agrees with a template's in a band retrieves the template. A copied passage of
WINDOW + STRIDE shingles holds a window of the text that equals one of the template, so it is retrieved with certainty;
a window of similarity s to its counterpart with probability 1 - (1 - s)^6, which is 0.984 at a half, and a text that
holds `percent` of a long template has many such windows.

A template under WINDOW shingles is retrieved by windows of its own scale, one shingle: then the minimum is the shingle
itself in each band, and any shared shingle retrieves it. One under five words is a shingle of its whole length; the
text's runs of that many words are its windows. All windows of a text, of all scales, are looked up in the same set of
keys.

For retrieval texts are folded to lower case whole, which is quicker than A-Z alone and joins no fewer words; retrieved
templates are compared as words. One matches if the text holds `percent` per cent of its distinct shingles.

What is sent to the workers are the templates' keys and shingles, some ten thousand whatever the input. Nothing is
shuffled.

Defined results: a null or empty text matches nothing, and one under five words only templates under five words. Only
matches are returned: per row of the input and template one row; rows repeated in the input give repeated matches. A
null id stays null. An empty table, or an empty list of templates, gives no rows. Further columns, whatever their names,
are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

WORDS, WINDOW, STRIDE = 5, 16, 8
#: Bits flipped before the least and greatest hash are taken: each mask gives two bands.
MASKS = (0, 0x2B5AD4CE93C1786F, 0x5E6F9A3D0C47B281)

# Texts of public licenses and notices, shortened to what identifies them.
TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "notice rights reserved": "All rights reserved",
    "notice MIT": "Released under the MIT License",
    "notice Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "rights reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
}


def templates() -> dict[str, str]:
    """Template texts by name: the fixed ones, and one-line notices of license families by version."""
    out = dict(TEXTS)
    for family, versions in (("GNU General Public License", "23"), ("GNU Lesser General Public License", "23"), ("GNU Affero General Public License", "3")):
        for v in versions:
            out[f"notice {family} {v}"] = f"This work is licensed under the {family}, version {v}"
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        for v in ("2.0", "3.0", "4.0"):
            out[f"notice CC {kind} {v}"] = f"Licensed under CC {kind} {v}"
    return out


def words_of(text: Column) -> Column:
    """Runs of letters and digits, A-Z in lower case."""
    upper = "".join(map(chr, range(65, 91)))
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _runs(words: Column, n: int, of: Callable[[list[Column]], Column]) -> Column:
    """`of` applied to each run of n words."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: of([F.get(words, i + k) for k in range(n)]))


def _shingle(run: list[Column]) -> Column:
    """Words hold no spaces, so a run of them is told by its text. (Arrays of texts are compared by hashing, those of structs pair by pair.)"""
    return F.concat_ws(" ", *run)


def _from(array: Column, start: int) -> Column:
    return F.slice(array, F.lit(start + 1), F.size(array))


def _joined(a: Column, b: Column, shift: int) -> Column:
    """Hashes of each of a with that of b `shift` places on, as far as both go."""
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(b) - shift, F.lit(0))), _from(b, shift), lambda x, y: F.xxhash64(x, y))


def _hashed(rows: DataFrame, text: Column, lengths: list[int]) -> DataFrame:
    """Columns h1 to h5: hashes of all runs of so many words of the text (h4 only if asked for by lengths).

    Longer runs are made of shorter ones, by one step a word each. Each array that a later step looks into is a column
    of its own, made once a row: an expression inside a lambda would be evaluated again for each element.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    rows = rows.withColumn("h1", F.transform(words, lambda w: F.xxhash64(w)))
    rows = rows.withColumn("h2", _joined(F.col("h1"), F.col("h1"), 1))
    rows = rows.withColumn("h3", _joined(F.col("h2"), F.col("h1"), 2))
    if 4 in lengths:
        rows = rows.withColumn("h4", _joined(F.col("h3"), F.col("h1"), 3))
    return rows.withColumn("h5", _joined(F.col("h3"), F.col("h2"), 3))


def _extremes(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """Columns low0, high0, low1, ...: for each mask the least and greatest hash of pieces of h5, `stride` apart.

    What a lambda slices must be used outside of it, too, or the optimizer moves the array's expression into the lambda.
    """
    for k, mask in enumerate(MASKS):
        m = F.col(f"m{k}")
        starts = F.when(F.size(m) > 0, F.sequence(F.lit(1), F.size(m), F.lit(stride))).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn(f"m{k}", F.transform("h5", lambda h: h.bitwiseXOR(F.lit(mask))) if mask else F.col("h5"))  # noqa: B023
        rows = rows.withColumn(f"pieces{k}", F.transform(starts, lambda i: F.slice(m, i, F.lit(size))))  # noqa: B023
        rows = rows.withColumn(f"low{k}", F.transform(f"pieces{k}", F.array_min)).withColumn(f"high{k}", F.transform(f"pieces{k}", F.array_max))
    return rows


def _band(extreme: Column, band: int) -> Column:
    """The key of a band: bands keep apart, and so do hashes of single shingles."""
    return extreme.bitwiseXOR(F.lit(0x1F3D5B79A8C6E402 + band))


def _with_keys(rows: DataFrame) -> DataFrame:
    """Column keys: those of all windows of a text, in all bands; a window is a block and the next (the last one alone)."""
    rows = _extremes(rows, STRIDE, STRIDE)
    # where there is no next block, the comparison skips the null
    bands = [(f"{side}{k}", pick_one) for k in range(len(MASKS)) for side, pick_one in (("low", F.least), ("high", F.greatest))]
    return rows.withColumn("keys", F.concat(*(F.zip_with(F.col(c), _from(F.col(c), 1), lambda x, y: _band(one(x, y), b)) for b, (c, one) in enumerate(bands))))  # noqa: B023


def template_table(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """license, n_shingles, shingles (distinct, as words), keys (of all its windows), n_words."""
    rows = spark.createDataFrame(sorted(texts.items()), "license string, template string").withColumn("words", words_of(F.col("template")))
    rows = _hashed(rows, F.col("template"), list(range(WORDS)))
    rows = _extremes(rows, WINDOW, 1)
    keys = F.concat(*(F.transform(f"{side}{k}", lambda x: _band(x, 2 * k + j)) for k in range(len(MASKS)) for j, side in enumerate(("low", "high"))))  # noqa: B023
    keys = F.when(F.size("h5") >= WINDOW, keys).otherwise(F.col("h5"))
    shingles = _runs(F.col("words"), WORDS, _shingle)
    for n in range(1, WORDS):  # the whole of a template of n words
        whole = F.size("words") == n
        shingles = F.when(whole, _runs(F.col("words"), n, _shingle)).otherwise(shingles)
        keys = F.when(whole, F.col(f"h{n}")).otherwise(keys)
    rows = rows.withColumn("shingles", F.array_distinct(shingles)).where(F.size("shingles") > 0)
    return rows.select("license", F.size("shingles").alias("n_shingles"), "shingles", F.array_distinct(keys).alias("keys"), F.size("words").alias("n_words"))


def license_matches(docs: DataFrame, texts: dict[str, str] | None = None, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, license, n_template (its shingles), n_shared, containment of each template that matches a row."""
    spark = docs.sparkSession
    table = template_table(spark, templates() if texts is None else texts).collect()  # as many rows as templates
    described = spark.createDataFrame([(r["license"], r["n_shingles"], r["shingles"]) for r in table], "license string, n_template int, shingles array<string>")
    retrieving = F.array(*(F.struct(F.lit(r["license"]).alias("license"), F.array(*map(F.lit, r["keys"])).alias("keys")) for r in table)) if table else F.array().cast("array<struct<license:string,keys:array<long>>>")
    lengths = sorted({r["n_words"] for r in table if r["n_words"] < WORDS})

    plain = pick(docs, id_col, text_col).toDF("id", "text")
    known = sorted({k for r in table for k in r["keys"]}) or [0]
    windows = _with_keys(_hashed(plain, F.col("text"), lengths))
    # single words are windows only if a template is one word; the set of keys is a constant, hashed once a plan
    hits = F.array_distinct(F.concat(*(F.filter(c, lambda h: h.isin(known)) for c in ("keys", "h5", *(f"h{n}" for n in lengths)))))
    # the row number, not being deterministic, keeps the filter above this step: below, its arrays would be made in lambdas;
    # it is used to the end, as a column that nothing needs would be pruned
    hit = windows.select("id", "text", hits.alias("hits"), F.monotonically_increasing_id().alias("row")).where(F.size("hits") > 0)
    # few rows are left: their templates, each once, are compared as words
    found = F.transform(F.filter(retrieving, lambda t: F.arrays_overlap(t["keys"], F.col("hits"))), lambda t: t["license"])
    told = hit.withColumn("words", words_of(F.col("text"))).select("id", "row", found.alias("licenses"), F.concat(*(_runs(F.col("words"), n, _shingle) for n in (WORDS, *lengths))).alias("own"))
    retrieved = told.select("id", "row", "own", F.explode("licenses").alias("license")).join(F.broadcast(described), "license")
    shared = F.size(F.array_intersect("own", "shingles"))
    # a row number again, as above, lest the comparison be made a second time in the filter
    compared = retrieved.select("id", "row", "license", "n_template", shared.alias("n_shared"), F.monotonically_increasing_id().alias("match"))
    matches = compared.where((F.col("n_shared") * 100 >= F.col("n_template") * percent) & (F.col("row") >= 0) & (F.col("match") >= 0))
    return matches.select(F.col("id").alias(id_col), "license", "n_template", "n_shared", F.round(F.col("n_shared") / F.col("n_template"), 6).alias("containment"))


def oracle(texts: dict[str, str] | None = None, percent: int = 80) -> str:
    """DuckDB SQL for license_matches over `documents`: every text against every template, without windows and bands.

    A template under five words is one shingle of its whole length; texts are searched for it as a run of words.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in sorted((templates() if texts is None else texts).items()))
    words = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    shingles = f"CASE WHEN len(words) >= {WORDS} THEN list_distinct(list_transform(range(1, len(words) - {WORDS - 2}), lambda i: array_to_string(words[i:i + {WORDS - 1}], ' '))) ELSE [] END"
    return f"""
WITH template(license, text) AS (VALUES {values}),
tw AS (SELECT license, {words} AS words FROM template),
ts AS (SELECT license, words, {shingles} AS shingles FROM tw),
dw AS (SELECT doc_id, {words} AS words FROM documents),
ds AS (SELECT doc_id, ' ' || array_to_string(words, ' ') || ' ' AS line, {shingles} AS shingles FROM dw),
m AS (SELECT doc_id, license, len(ts.shingles)::INTEGER AS n_template, len(list_intersect(ds.shingles, ts.shingles))::INTEGER AS n_shared FROM ds, ts WHERE len(ts.shingles) > 0
  UNION ALL SELECT doc_id, license, 1, contains(line, ' ' || array_to_string(words, ' ') || ' ')::INTEGER FROM ds, ts WHERE len(words) BETWEEN 1 AND {WORDS - 1})
SELECT doc_id, license, n_template, n_shared, round(n_shared / n_template, 6) AS containment FROM m WHERE n_shared * 100 >= n_template * {percent}
"""
