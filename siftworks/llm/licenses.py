"""License scan with DataFrame functions only: MinHash bands over windows, then exact containment.

Texts and templates are lower-cased runs of letters and digits.  For a template of n words, windows
have n + n // 4 words and start every n // 4 (at least one) words, so wherever a copy of the template
stands, a window holds all of it.  Windows and templates have MinHash signatures over five-word
shingles in BANDS bands of one row.  A window that holds a whole copy has a Jaccard similarity of
at least 0.5 to its template, one with a containment of 0.8 at least 0.4: the chance that no band
agrees is below 6e-8 and 5e-6.  Windows in a shared band are verified: a match has a containment -
the share of the template's shingles that are in the window - of at least CONTAINMENT.

Windows are formed only around cue words.  Each template has cues in more than 1 - CONTAINMENT of
its shingles (checked when templates are read), so a match always has a cue in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftworks.llm.scratch import Scratch

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 24
# Public license notices and the words that mark them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "warranty-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}
CUES = "license licensed licenses sublicense software warranty warranties permission permissions permitted redistribution redistribute distribute distributed copyright merchantability noninfringement fitness gnu copies".split()
_BREAK = r"[^\p{L}\p{N}]+"


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


class Templates:
    """Templates by name, checked against the cues."""

    def __init__(self, texts: dict[str, str] | None = None, cues: list[str] | None = None):
        self.cues = cues or CUES
        self.words = {name: w for name, t in sorted((TEMPLATES if texts is None else texts).items()) if (w := _words(t))}
        for name, w in self.words.items():
            s = [w[i : i + SHINGLE] for i in range(max(1, len(w) - SHINGLE + 1))]
            bare = {" ".join(x) for x in s if not set(x) & set(self.cues)}
            if len(bare) / len({" ".join(x) for x in s}) >= CONTAINMENT:
                raise ValueError(f"template {name} could match without a cue")

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = F.array(*(F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, w)).alias("words"), F.lit(len(w)).alias("size")) for n, w in self.words.items()))
        return spark.range(1).select(F.inline(rows))


def _shingles(words: Column) -> Column:
    """Distinct shingles; a shorter text is one shingle."""
    last = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " ")))


def _bands(shingles: Column) -> Column:
    """One MinHash value for each band."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.array(hashes), lambda h: F.array(*(F.array_min(F.transform(h, lambda x: F.xxhash64(F.lit(t), x))) for t in range(BANDS))))[0]


def scan_licenses(docs: DataFrame, templates: Templates | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, license, first_word, n_words, containment, evidence).

    One row for each doc_id and template that it holds: the window of the highest containment, the
    first of equals, with its words as evidence; documents without a license have no row.  Whole
    texts; null and empty texts match nothing; rows with one doc_id (null is one too) are taken
    together; other columns are ignored.
    """
    spark = docs.sparkSession
    known = templates or Templates()
    made = known.frame(spark).withColumn("t_shingles", _shingles(F.col("words"))).select("license", F.col("size").alias("t_size"), "t_shingles")
    cue = f"(?<![\\p{{L}}\\p{{N}}])(?:{'|'.join(known.cues)})(?![\\p{{L}}\\p{{N}}])"
    low = F.lower("text")
    cued = docs.where(low.rlike(cue)).select(F.col("doc_id").cast("long").alias("doc_id"), F.filter(F.split(low, _BREAK), lambda w: w != "").alias("words"))
    is_cue = F.array(*map(F.lit, known.cues))
    places = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(is_cue, w), i)), lambda i: i.isNotNull())
    scratch = Scratch(spark)
    cued = scratch.table("cued", cued.withColumn("places", places))  # one scan of the texts, few of which have a cue
    scratch.hold()
    shapes = F.array(*(F.struct(F.lit(n).alias("size"), F.lit(max(1, n // 4)).alias("step"), F.lit(n + max(1, n // 4)).alias("length")) for n in sorted({len(w) for w in known.words.values()})))

    def windows_of(shape: Column) -> Column:
        step, length = shape["step"], shape["length"]
        around = lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((p - length + 1) / step)).cast("int"), F.floor(p / step).cast("int"))
        numbers = F.array_distinct(F.flatten(F.transform("places", around)))
        return F.transform(numbers, lambda k: F.struct(shape["size"].alias("size"), (k * step).alias("first_word"), F.slice("words", k * step + 1, length).alias("window")))

    windows = cued.select("doc_id", F.inline(F.flatten(F.transform(shapes, windows_of)))).withColumn("w_shingles", _shingles(F.col("window")))
    left = windows.select("*", F.posexplode(_bands(F.col("w_shingles"))).alias("band", "key"))
    right = made.select("*", F.posexplode(_bands(F.col("t_shingles"))).alias("band", "key"))
    on = (left.size == right.t_size) & (left.band == right.band) & (left.key == right.key)
    pairs = left.join(F.broadcast(right), on)  # as many rows as templates have bands: fixed
    shared = F.size(F.array_intersect("t_shingles", "w_shingles")) / F.size("t_shingles")
    found = pairs.withColumn("containment", shared).where(F.col("containment") >= containment)
    found = found.select("doc_id", "license", "first_word", F.size("window").alias("n_words"), "containment", F.array_join("window", " ").alias("evidence"))
    best = F.max_by(F.struct("first_word", "n_words", "containment", "evidence"), F.struct(F.col("containment"), -F.col("first_word"), "evidence"))
    return found.groupBy("doc_id", "license").agg(best.alias("best")).select("doc_id", "license", "best.*")
