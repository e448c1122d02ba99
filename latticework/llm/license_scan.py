"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle
containment verifies them. DataFrame operations only.

A text becomes lower-case alphanumeric words and hashed word shingles. Every ``stride`` shingles a
window of ``window`` shingles starts. Its MinHash under permutation b (the shingle hash xor constant
b, a permutation of the hash space) is band b; templates are cut into windows at every offset, long
ones at every ``window``-th, which still covers all their shingles. A template of up to ``window -
stride + 1`` shingles lies whole in some window, so the similarity of the two is at least its share of
the window, and any band agrees with that probability; with the bands used here a template of three
shingles is missed with probability (1 - 1/2) ** 24 < 1e-7 (see ``collision_probability``). Retrieved
places are verified: the share of the template's distinct shingles that the text has there, exactly,
must be ``containment`` or more.

Up to ``max_index`` rows of the index and as many shingles of templates, both are broadcast, and all is
one pass over the texts without a shuffle of them. Beyond that, bands alone are joined by shuffle, and the
texts are fetched for the documents that have a place.

Edge cases: null and empty texts have no shingle and no row; texts shorter than a shingle have none;
rows equal in doc_id and text are one document (the best place of any), rows that share a doc_id (or have
none) and differ in text are scanned each; templates shorter than a shingle are an error; an empty table
gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, as their licences ask them to be written.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def collision_probability(share: float, bands: int = 24) -> float:
    """That a window and a template of this similarity meet in a band (of one MinHash each)."""
    return 1 - (1 - share) ** bands


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def _shingles(words: Column, size: int) -> Column:
    at = lambda i, j: F.get(words, i + j)
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[at(i, F.lit(j)) for j in range(size)]))).otherwise(F.array().cast("array<bigint>"))


def _constants(bands: int) -> list[int]:
    """Constants whose top bits differ: multiples of the golden ratio, as signed 64-bit numbers."""
    return [((b + 1) * 0x9E3779B97F4A7C15 + 2**63) % 2**64 - 2**63 for b in range(bands)]


def _banded(rows: DataFrame, at: str, window: int, bands: int) -> DataFrame:
    """A row per band: its number and the MinHash of the window that starts at ``at`` in ``sh``.

    Places past the end are null and do not count. The bands are exploded before they are computed,
    which keeps the generated code small enough to be compiled.
    """
    constants = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(c).alias("c")) for b, c in enumerate(_constants(bands))])
    each = rows.select("*", F.explode_outer(constants).alias("x"))
    value = F.least(*[F.get("sh", F.col(at) + j).bitwiseXOR(F.col("x.c")) for j in range(window)])
    # coalesce: a value that cannot be null needs no filter ahead of the join, which would compute it twice
    return each.select(*rows.columns, F.col("x.band").alias("band"), F.coalesce(value, F.lit(0)).alias("value"))


NO_ID = -(2**63)
DOC = ["d", "th"]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, shingle: int = 3, window: int = 6, stride: int = 3, bands: int = 24, containment: float = 0.8, max_index: int = 200_000) -> DataFrame:
    """``doc_id, license, containment, first_word, n_words``: the best place of each licence in a document."""
    spark = docs.sparkSession
    given = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, template string")
    cut = given.select("license", _words(F.col("template")).alias("words")).select("license", F.size("words").alias("n_words"), _shingles(F.col("words"), shingle).alias("sh"))
    last = F.greatest(F.lit(0), F.size("sh") - window)
    starts = F.sequence(F.lit(0), last, F.when(F.size("sh") > 4 * window, window).otherwise(1))
    at = cut.select("license", "sh", F.explode(F.array_distinct(F.concat(starts, F.array(last)))).alias("q"))
    index = _banded(at, "q", window, bands).select("license", "q", F.col("band").alias("own_band"), "value")
    rows, shingles, least = cut.agg(F.sum(bands * (F.size("sh") / F.when(F.size("sh") > 4 * window, window).otherwise(1) + 2)), F.sum(F.size("sh")), F.min(F.size("sh"))).first()
    if not least:
        raise ValueError("a template without a shingle")
    one_pass = max(rows, shingles) <= max_index
    cut = cut.select("license", "n_words", F.col("sh").alias("tsh"))

    keyed = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), _words(F.col("text")).alias("words"))
    texts = keyed.select(*DOC, _shingles(F.col("words"), shingle).alias("sh"))
    # explode_outer: for explode the optimizer would infer a filter and push all of the above into it
    starts = F.when(F.size("sh") > 0, F.sequence(F.lit(0), F.size("sh") - 1, F.lit(stride)))
    at = _banded(texts.select(*DOC, "sh", F.explode_outer(starts).alias("p")), "p", window, bands)
    at = at if one_pass else at.drop("sh")
    # the band is compared apart, so that the key of the hash join is one number
    found = at.join(F.broadcast(index) if one_pass else index.hint("merge"), "value").where(F.col("band") - F.col("own_band") == 0)
    # where the template would start, give or take what lies between the places of the shared shingle
    found = found.withColumn("start", F.greatest(F.lit(0), F.col("p") - F.col("q") - window + 1))
    if one_pass:
        found = found.join(F.broadcast(cut), "license")
    else:
        found = found.select(*DOC, "license", "start").distinct().join(cut, "license").join(texts.dropDuplicates(DOC).hint("merge"), DOC)
    # what stands there is cut out in generated code, so that no row holds a whole text from here on; the
    # higher-order functions that follow stay out of the generated code of the join's inner loop
    found = found.select(*DOC, "license", "n_words", "start", "tsh", F.slice("sh", F.col("start") + 1, F.size("tsh") + 2 * window - 2).alias("there"))
    common = F.filter(F.array_distinct("tsh"), lambda x: F.array_contains("there", x))
    places = found.select(*DOC, "license", "n_words", (F.size(common) / F.size(F.array_distinct("tsh"))).alias("containment"), (F.col("start") + F.array_position("there", common[0])).alias("at"))
    best = places.groupBy(*DOC, "license", "n_words").agg(F.min(F.struct((-F.col("containment")).alias("c"), "at")).alias("x")).where(-F.col("x.c") >= containment)
    doc_id = F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id")
    return best.select(doc_id, "license", F.round(-F.col("x.c"), 6).alias("containment"), (F.col("x.at") - 1).cast("int").alias("first_word"), "n_words")
