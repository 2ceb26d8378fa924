"""License scan: Dice coefficient over word bigrams (DataFrame operations only).

A text is normalised (lower case, words of letters and digits, line feeds
kept); its units are its lines, its paragraphs (between lines without words) and
the whole of it.  A unit is compared with each template by the Dice coefficient
of their multisets of word bigrams.  With a threshold of ``t`` a unit of ``n``
bigrams can match a template of ``m`` only if ``t / (2 - t) <= n / m <=
(2 - t) / t``: units whose number of words is outside all templates' bounds are
dropped before their bigrams are made, and the rest meets only the templates
that share a bigram.  Notices inside a longer line or paragraph are no units of
their own and are not looked for.

The templates are a fixed table of a few dozen rows, so it may be broadcast.

Defined cases: null and empty texts, and units below two words, match nothing;
of units that match equally well the first counts (whole text, then paragraphs,
then lines); rows that repeat an id are scanned on their own and their best
result counts; a null ``doc_id`` is a group of its own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depinfer.llm.common import ship, text_or_empty

# Licence names and the public wording of their notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
)


def normalised(text):
    """Lower-case words with single spaces, and the line feeds."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def normalised_words(text):
    """The words of a normalised text."""
    return F.split(F.trim(F.regexp_replace(text, r"[ \n]+", " ")), " ")


def _bigrams(rows: DataFrame, carried, keep, wanted: str = "true") -> DataFrame:
    """``keep, bigram`` for each two neighbouring words of ``words``, where ``wanted`` holds.

    The outer explode keeps the optimizer from filtering by the exploded array
    below it, which would compute the words anew for each such filter.
    """
    places = F.expr(f"if(size(words) >= 2 and ({wanted}), sequence(0, size(words) - 2), cast(array() as array<int>))")
    placed = rows.select(*carried, "words", F.explode_outer(places).alias("at")).filter("at is not null")
    return placed.select(*keep, F.xxhash64(F.expr("words[at]"), F.expr("words[at + 1]")).alias("bigram"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """``template, license, size, bigram, times``: the bigrams of each template."""
    named = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)], "template int, license string, text string")
    rows = named.withColumn("words", normalised_words(normalised(F.col("text"))))
    return _bigrams(rows, ["template", "license"], ["template", "license", F.expr("size(words) - 1").alias("size")]).groupBy("template", "license", "size", "bigram").agg(F.count("*").alias("times"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """``doc_id, license, dice, unit`` for each licence that a document's best unit matches.

    ``unit``: 0 whole text, 1 a paragraph, 2 a line.
    """
    spark = docs.sparkSession
    # A little wider than the bounds, so that rounding loses no unit that lies on them.
    low, high = threshold / (2 - threshold) * (1 - 1e-9), (2 - threshold) / threshold * (1 + 1e-9)
    known = template_table(spark, templates)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(text_or_empty()).alias("text"))
    unit = lambda kind, x: F.struct(F.lit(kind).alias("unit"), x.alias("said"))
    none = F.expr("cast(array() as array<struct<unit:int,said:string>>)")
    units = F.concat(
        F.array(unit(0, F.col("text"))),
        F.when(F.col("text").rlike(r"\n *\n"), F.transform(F.split("text", r"\n *(?:\n *)+"), lambda x: unit(1, x))).otherwise(none),
        F.when(F.instr("text", "\n") > 0, F.transform(F.split("text", "\n"), lambda x: unit(2, x))).otherwise(none),
    )
    counted = [r["size"] for r in known.select("size").distinct().collect()]
    # A unit has at least a space or line feed for each bigram.
    gaps = F.length("said") - F.length(F.translate("said", " \n", ""))
    said = rows.select("doc_id", F.posexplode_outer(units).alias("place", "u")).select("doc_id", "place", "u.unit", "u.said")
    said = said.filter(gaps >= low * min(counted, default=0))
    bounds = " or ".join(f"size(words) - 1 between {low * n} and {high * n}" for n in counted) or "false"
    words = said.select("doc_id", "place", "unit", F.xxhash64("said").alias("key"), normalised_words(F.col("said")).alias("words"))
    carried = ["doc_id", "place", "unit", "key"]
    hits = _bigrams(words, carried, [*carried, F.expr("size(words) - 1").alias("n")], bounds).join(F.broadcast(known), "bigram")
    hits = hits.filter(f"n between {low} * size and {high} * size")
    shared = hits.groupBy("doc_id", "place", "unit", "key", "n", "template", "license", "size", "bigram").agg(F.least(F.count("*"), F.first("times")).alias("both"))
    dice = shared.groupBy("doc_id", "place", "unit", "key", "n", "template", "license", "size").agg((2 * F.sum("both") / (F.col("n") + F.col("size"))).alias("dice")).filter(F.col("dice") >= threshold)
    best = dice.groupBy("doc_id", "license").agg(F.max(F.struct("dice", (-F.col("unit")).alias("first"))).alias("b"))
    return best.select("doc_id", "license", F.round("b.dice", 6).alias("dice"), (-F.col("b.first")).cast("int").alias("unit"))


ship(__name__)
