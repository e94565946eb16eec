"""License scans by MinHash bands over overlapping windows, in DataFrame operations only.

Texts are lower-cased and cut into runs of letters and digits; five words in a row are a shingle.
Only shingles that some template has can ever count, so a text's shingles first meet the bounded
set of all template shingles in a broadcast join, and everything after works on the few that are
left.

Windows of 4, 8, ... shingles, each overlapping the next by half, get a MinHash of their left-over
shingles in ``BANDS`` bands of one row. A template of n shingles is looked up at the smallest
window that surely holds it whole (n <= size / 2 + 1). Such a window has at most size < 4 n
shingles, so where 0.8 of the template is there, the two sets have a similarity of 0.2 or more and
a band collides with a probability of at least 1 - 0.8 ** 32 > 0.999. Then the share of the
template's shingles in the window is counted exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import ROW, materialise, text_of, with_row_key

SHINGLE = 5
BANDS = 32
CONTAINED = 0.8
#: Public license notices, as their publishers word them.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: str) -> list[str]:
    """A text's words as the scan sees them."""
    return re.findall("[a-z0-9]+", text.lower())


def _shingles(words):
    """Hashes of all shingles of an array column of words, in order."""
    last = F.size(words) - SHINGLE
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<long>"))


def _band(h, k: int):
    return F.min(F.xxhash64(h, F.lit(k)))


def template_shingles(spark, templates: dict[str, str]) -> DataFrame:
    """template, h, n (distinct shingles of the template), scale (size of the windows it is
    looked up in)."""
    rows = [(name, words_of(text)) for name, text in templates.items() if len(words_of(text)) >= SHINGLE]
    each = spark.createDataFrame(rows, "template string, words array<string>").select("template", F.explode(F.array_distinct(_shingles(F.col("words")))).alias("h"))
    n = F.count("h").over(Window.partitionBy("template"))
    scale = F.greatest(F.lit(4), F.pow(2, F.ceil(F.log2(2.0 * (F.col("n") - 1) + 1e-9)))).cast("int")
    return each.withColumn("n", n).withColumn("scale", F.when(F.col("n") == 1, 4).otherwise(scale))


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, str] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """One row per place where a template is found: doc_id, template, start_word, end_word,
    containment (the largest share of the template's shingles in one window).

    Words are counted from 0 over runs of a-z and 0-9 in the lower-cased text; end is exclusive.
    Places of a template that overlap are one. Templates of under five words can't be found. Null
    and empty texts have none; repeated rows and rows with null ids are scanned like any other and
    give rows of their own; an empty table gives no rows. The templates are the caller's and
    bounded: their shingles are broadcast.
    """
    known = materialise(template_shingles(df.sparkSession, templates), "templates")
    sizes = sorted(r[0] for r in known.select("scale").distinct().collect())
    words = F.split(F.trim(F.regexp_replace(F.lower(text_of(text)), "[^a-z0-9]+", " ")), " ")
    rows = with_row_key(df).select(F.col(doc_id).alias("doc_id"), *ROW, words.alias("words"))
    each = rows.select("doc_id", *ROW, F.posexplode(_shingles(F.col("words"))).alias("pos", "h"))
    hits = materialise(each.join(F.broadcast(known.select("h").distinct()), "h"), "hits")
    if not sizes:
        return hits.select("doc_id", F.lit("").alias("template"), "pos", "pos", F.lit(1.0)).where("false").toDF("doc_id", "template", "start_word", "end_word", "containment")
    at = [F.struct(F.lit(s).alias("scale"), (F.floor(F.col("pos") / (s // 2)) - back).alias("window")) for s in sizes for back in (0, 1)]
    placed = hits.select("doc_id", *ROW, "pos", "h", F.explode(F.array(*at)).alias("at")).select("doc_id", *ROW, "pos", "h", "at.*")
    key = [*ROW, "scale", "window"]
    bands = lambda frame, *by: frame.groupBy(*by).agg(*(_band("h", k).alias(f"b{k}") for k in range(BANDS))).select(*by, F.posexplode(F.array(*(f"b{k}" for k in range(BANDS)))).alias("band", "value"))
    wanted = bands(known, "template", "n", "scale")
    found = bands(placed, *key).join(F.broadcast(wanted), ["scale", "band", "value"]).select(*key, "template", "n").distinct()
    exact = placed.join(found.hint("merge"), key).join(F.broadcast(known.select("template", "h")), ["template", "h"])
    matched = exact.groupBy("doc_id", *key, "template", "n").agg(F.countDistinct("h").alias("common"), F.min("pos").alias("start"), (F.max("pos") + SHINGLE).alias("end"))
    matched = matched.withColumn("containment", F.col("common") / F.col("n")).where(F.col("containment") >= contained)
    order = Window.partitionBy(*ROW, "template").orderBy("start", "end")
    ahead = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = matched.withColumn("new", (ahead.isNull() | (F.col("start") >= ahead)).cast("int")).withColumn("island", F.sum("new").over(order))
    places = island.groupBy("doc_id", *ROW, "template", "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.max("containment").alias("containment"))
    return places.select("doc_id", "template", F.col("start_word").cast("long"), F.col("end_word").cast("long"), "containment")
