"""Licence scan in DataFrame expressions only: MinHash over overlapping windows retrieves templates, containment verifies.

Words are runs of letters a-z and digits after lower-casing; shingles are five words. A template of n shingles belongs to
the scale L = the least power of two that is at least n, and is looked for in windows of 2 * L shingles, one every L, so
that every occurrence lies whole in some window. There the similarity of window and template is at least a quarter (0.19
if a fifth of the template is missing), and of BANDS bands of one MinHash each, at least one agrees with a probability of
1 - (1 - 0.19) ** 64 > 0.999998. A retrieved template is verified exactly: at least CONTAINMENT of its shingles must be in
the window.

Before that, two filters lose nothing: a document, then a window, goes on only if it holds a shingle of some template.

Scale: everything up to the matches happens in the row, with no shuffle and no Python; only matches are grouped. The
templates are a fixed list in this file, or a table given by the caller; more than MOST_TEMPLATES are looked for block by
block, each in a pass of its own, so that what a task is sent stays small.

Cases: null, empty and short texts (under five words) match nothing. Rows that share a doc_id, null among them, are one
document; ties and repeated rows change nothing. Very long texts are scanned whole. Empty tables, of documents or of
templates, give no row. Only id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
BANDS = 64
CONTAINMENT = 0.8
MOST_TEMPLATES = 2000

#: Licence notices and opening or key paragraphs of public licence texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "disclaimer": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
}


def bound(value: str, name: str, body: str) -> str:
    """SQL for body with name standing for value, which is evaluated once: a lambda's variable is never inlined."""
    return f"transform(array({value}), {name} -> {body})[0]"


def shingles(text: str) -> Column:
    """Hash of each run of five words of the string column text, in order; repeats stay."""
    words = f"split(btrim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ')), ' ')"
    run = ", ".join(f"w[i + {k}]" for k in range(SHINGLE))
    hashed = f"CASE WHEN size(w) >= {SHINGLE} THEN transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({run})) ELSE CAST(array() AS array<bigint>) END"
    return F.expr(bound(words, "w", hashed))


def signature(s: str) -> Column:
    """One number per band for the array column s of shingles: its least hash, mixed with the band."""
    return F.expr(bound(s, "s", f"transform(sequence(1, {BANDS}), j -> xxhash64(j, array_min(transform(s, x -> xxhash64(x, j)))))"))


def prepared(spark: SparkSession, texts: dict[str, str] | DataFrame | None = None) -> list[tuple]:
    """(name, scale, distinct shingles, signature) per template of five words or more."""
    if not isinstance(texts, DataFrame):
        texts = spark.createDataFrame(list((TEMPLATES if texts is None else texts).items()), "template string, text string")
    rows = texts.select("template", F.array_distinct(shingles("text")).alias("s")).filter("size(s) > 0")
    return [(r.template, 1 << (len(r.s) - 1).bit_length(), list(r.s), list(r.sig)) for r in rows.withColumn("sig", signature("s")).collect()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """(id, template, containment, first_word, n_windows): per document and template found, the best containment, where
    the first window with it starts, and in how many windows it was found."""
    if isinstance(templates, DataFrame) and (n := -(-templates.count() // MOST_TEMPLATES)) > 1:
        part = F.pmod(F.xxhash64("template", "text"), F.lit(2 * n))  # blocks differ in size, so twice as many
        found = [scan(docs, id_col, text_col, templates.filter(part == i)) for i in range(2 * n)]
        same = functools.reduce(DataFrame.unionByName, found).groupBy(id_col, "template")  # one name may have several texts
        return same.agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.sum("n_windows").alias("n_windows"))
    spark = docs.sparkSession
    known = prepared(spark, templates)
    every = sorted({x for t in known for x in t[2]})
    if not every:
        every = [0]
    found = docs.select(F.col(id_col), shingles(f"`{text_col}`").alias("_s"))
    found = found.filter(F.arrays_overlap("_s", F.lit(every)))
    scales = sorted({t[1] for t in known})
    mine = {scale: sorted({x for t in known if t[1] == scale for x in t[2]}) for scale in scales}
    # windows of every scale that holds a shingle of the document
    starts = F.expr(f"filter(array({', '.join(map(str, scales)) or 'cast(null as int)'}), l -> l IS NOT NULL)")
    rows = found.withColumn("_l", F.explode(starts)).withColumn("_from", F.explode(F.expr("sequence(0, size(_s) - 1, _l)")))
    rows = rows.select(id_col, "_l", "_from", F.expr("array_distinct(slice(_s, _from + 1, 2 * _l))").alias("_win"))
    hit = F.lit(False)
    for scale in scales:
        hit = F.when(F.col("_l") == scale, F.arrays_overlap("_win", F.lit(mine[scale]))).otherwise(hit)
    rows = rows.filter(hit).withColumn("_sig", signature("_win"))
    table = spark.createDataFrame(known, "template string, _tl int, _ts array<long>, _tsig array<long>")
    bands = table.select("template", "_tl", "_ts", F.explode("_tsig").alias("_band"))  # at most MOST_TEMPLATES * BANDS rows
    banded = rows.select(id_col, "_l", "_from", "_win", F.explode(F.array_distinct("_sig")).alias("_band"))
    retrieved = banded.join(F.broadcast(bands), "_band").filter("_l = _tl")
    share = F.size(F.array_intersect("_win", "_ts")) / F.size("_ts")
    checked = retrieved.withColumn("_share", share).filter(F.col("_share") >= CONTAINMENT)
    return checked.groupBy(id_col, "template").agg(F.max("_share").alias("containment"), F.min("_from").cast("long").alias("first_word"), F.count_distinct("_from").alias("n_windows"))
