"""License scan: Dice coefficient over word bigrams against templates. Column functions and joins only.

A unit is a line of a text, or a paragraph (lines up to a blank one); its normalised words make a set of bigrams,
as do those of each template. For a Dice coefficient of ``least`` a unit must have between
least / (2 - least) and (2 - least) / least times as many bigrams as the template, so units
that suit no template are left alone, and the others meet only templates that their size
allows: bigrams join on the bigram, with the bounds in the condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence notices and texts, in the order of the SPDX list.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with"
        " the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to"
        " permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "proprietary": ["All rights reserved."],
}
LEAST = 0.8


def words_of(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; one empty word where there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def pairs_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words, a lone word by itself."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))),
                       F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(words == F.array(F.lit("")), F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words: lower-cased runs of a-z and 0-9, a lone word by itself."""
    return pairs_of(words_of(text))


def _once(name: str, value: Column) -> Column:
    """``value`` as a generated column, which is not worked out again in each place that reads it."""
    return F.explode_outer(F.array(value)).alias(name)


def templates(spark: SparkSession, texts: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(license, template, bigram, m): a row for each bigram of each template, ``m`` their number."""
    rows = [(name, k, text) for name, several in texts.items() for k, text in enumerate(several)]
    sets = spark.createDataFrame(rows, "license string, template int, text string").withColumn("b", bigrams(F.col("text")))
    return sets.select("license", "template", F.explode("b").alias("bigram"), F.size("b").alias("m"))


def scan(docs: DataFrame, texts: dict[str, list[str]] = TEMPLATES, *, id_col: str = "doc_id", text_col: str = "text",
         least: float = LEAST) -> DataFrame:
    """(id, line, license, dice): the best template of each licence for each unit that reaches ``least``.

    ``line`` counts from 0; paragraphs of several lines are numbered -1, -2, and so on. Null and
    empty texts, and units without words, match nothing. Rows with equal id and text count
    as one; a null id is a key like another; an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = templates(spark, texts)
    most = max(len(t.split()) for several in texts.values() for t in several)  # words bound bigrams
    low, high = least / (2 - least), (2 - least) / least
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    lines = slim.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    blocks = slim.where(F.contains("text", F.lit("\n"))).select(
        "id", "mark", F.posexplode(F.split("text", r"\n[\t ]*\n")).alias("line", "unit"))
    blocks = blocks.where(F.contains("unit", F.lit("\n"))).withColumn("line", -1 - F.col("line"))
    units = lines.unionByName(blocks).select("id", "mark", "line", _once("words", words_of(F.col("unit"))))
    # n different pairs have n + 1 different words at most
    units = units.where(F.size(F.array_distinct("words")) <= most * high + 1)
    sets = units.select("id", "mark", "line", _once("b", pairs_of(F.col("words"))))
    sets = sets.withColumn("n", F.size("b")).where((F.col("n") > 0) & (F.col("n") <= most * high))
    shared = (
        sets.select("id", "mark", "line", "n", F.explode("b").alias("bigram"))
        .join(F.broadcast(known), "bigram")  # the templates: a fixed table
        .where((F.col("n") >= F.col("m") * low - 1e-9) & (F.col("n") <= F.col("m") * high + 1e-9))
        .groupBy("id", "mark", "line", "license", "template", "n", "m").agg(F.count_distinct("bigram").alias("c"))
    )
    dice = shared.withColumn("dice", 2 * F.col("c") / (F.col("n") + F.col("m"))).where(F.col("dice") >= least)
    return dice.groupBy("id", "line", "license").agg(F.max("dice").alias("dice"))
