"""Operator 2: license notices by diagonal voting.

Every run of ``GRAM`` words of every document is hashed and joined with the same
runs of the templates. A match votes for its diagonal, document place minus
template place: words copied in order share one. Votes are counted per document,
template and diagonal before the shuffle; neighbouring diagonals, which an
inserted or lost word leads to, are merged as long as all of them lie within the drift that edits of the
template's length may make. So a span is no longer than the template and its drift, its words stand in the template's
order, and it is verified by the share of the template's runs that stand in it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airsleuth.llm.tables import table, whole_text

GRAM = 3
#: Diagonals so near are one span.
NEAR = 4
#: All diagonals of a span lie within this share of the template's words, or within NEAR.
DRIFT = 0.15
#: Share of a template's runs that a span must hold; all of them in templates of under ``SHORT`` runs.
COVER = 0.7
SHORT = 10
#: Templates of more runs than this are joined by a shuffle; fewer are some MB at most and are broadcast.
BROADCAST_RUNS = 50_000

# The phrases whose places are counted, and their labels.
PHRASES = [
    ("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"),
]
# Wordings of public license notices, with the labels they give.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in "
                 "compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("bsd", "under the bsd license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
              "general public license as published by the free software foundation either version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nc", "under cc by nc 4 0"),
    ("cc-by", "creative commons attribution 4 0 international"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "creative commons zero public domain dedication"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this"),
]
# Whole texts of public licenses, with the labels they give.
TEXTS = [
    ("mit", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY
OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""),
]


def words(text: Column) -> Column:
    """Words of digits, a to z after lower-casing A to Z, and characters beyond ASCII.

    ``lower`` also maps letters beyond ASCII, which changes no word's bounds and
    no template word; only the Kelvin sign would become an ASCII letter, so it is
    set aside first.
    """
    low = F.lower(F.replace(text, F.lit("K"), F.lit("°")))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), "")


def plain_words(text: str) -> list[str]:
    """The words of a template, by the rule of ``words``."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def template_grams(spark: SparkSession, phrases: list, notices: list) -> DataFrame:
    """Runs of all templates: ``gram``, its ``hash``, ``template``, ``at``; bounded by the templates' words."""
    rows = [
        (i, label, is_phrase, at, " ".join(text[at:at + GRAM]), len(text) - GRAM + 1)
        for i, (label, is_phrase, text) in enumerate(
            [(k, True, plain_words(v)) for k, v in phrases] + [(k, False, plain_words(v)) for k, v in notices])
        for at in range(len(text) - GRAM + 1)
    ]
    return spark.createDataFrame(rows, "template int, label string, base boolean, at int, gram string, grams int")


def scan_licenses(docs: DataFrame, phrases: list = PHRASES, notices: list = [*NOTICES, *TEXTS],
                  near: int = NEAR, cover: float = COVER) -> DataFrame:
    """Licenses of every document.

    One row for every row, also for rows that repeat. A null or wordless text has no words and no
    labels. Phrases and notices need at least ``GRAM`` words and may be whole license texts.
    ``n_base``, ``first_word`` and ``last_word`` tell the places of the phrases,
    ``labels`` all found labels, ``score`` the best share of a template's runs in
    a verified span, ``spans`` the verified spans.
    """
    spark = docs.sparkSession
    few = sum(len(plain_words(text)) for _, text in [*phrases, *notices]) <= BROADCAST_RUNS
    templates = template_grams(spark, phrases, notices).withColumn("hash", F.xxhash64(F.split("gram", " ")))
    size = F.size("words")
    grams = F.transform(F.sequence(F.lit(0), size - GRAM), lambda i: F.xxhash64(F.slice("words", i + 1, GRAM)))
    # One row for the document itself, numbered 0, and one for each run of words. "Outer" changes no row, but
    # keeps Spark from inferring a filter on the array's size, which would split the text anew for each run.
    runs = (
        docs.select(F.col("doc_id"), F.xxhash64(whole_text()).alias("content"), words(whole_text()).alias("words"))
        .select("doc_id", "content", "words", F.posexplode_outer(F.concat(
            F.array(F.lit(None).cast("long")), F.when(size >= GRAM, grams).otherwise(F.array().cast("array<bigint>"))
        )).alias("place", "hash"))
    )
    here = F.array_join(F.slice("words", F.col("place"), GRAM), " ")
    runs = runs.withColumn("n_words", F.when(F.col("place") == 0, size))
    if few:
        matched = runs.join(F.broadcast(templates), "hash", "left").filter((F.col("place") == 0) | (here == F.col("gram")))
    else:  # each run carries its own words through the shuffle
        runs = runs.withColumn("here", F.when(F.col("place") > 0, here)).drop("words")
        matched = runs.join(templates, "hash", "left").filter((F.col("place") == 0) | (F.col("here") == F.col("gram")))
    votes = matched.select(
        "doc_id", "content", "n_words",
        "template", "label", "base", "grams", (F.col("place") - 1).alias("at"),
        (F.col("place") - 1 - F.col("at")).alias("diagonal"), F.col("at").alias("template_at"))
    diagonals = votes.groupBy("doc_id", "content", "template", "diagonal").agg(
        F.max("n_words").alias("n_words"), F.count("n_words").alias("rows"), F.max("label").alias("label"), F.max("base").alias("base"),
        F.max("grams").alias("grams"), F.min("at").alias("first"), F.max("at").alias("last"),
        # A match stands on one diagonal, so that these sets have at most as many entries as the text has words.
        F.collect_set("template_at").alias("seen"))
    found = diagonals.groupBy("doc_id", "content", "template").agg(
        F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"), F.max("label").alias("label"), F.max("base").alias("base"),
        F.max("grams").alias("grams"),
        F.sort_array(F.collect_list(F.when(F.col("diagonal").isNotNull(), F.struct(
            "diagonal", "first", "last", "seen", F.col("diagonal").alias("lowest"))))).alias("diagonals"))
    # Neighbouring diagonals become one span: its last diagonal, its words and the template runs seen in it.
    span = "struct<diagonal:int,first:int,last:int,seen:array<int>,lowest:int>"
    drift = F.greatest(F.lit(near), F.ceil((F.col("grams") + GRAM - 1) * F.lit(DRIFT)).cast("int"))
    merged = F.aggregate("diagonals", F.array().cast(f"array<{span}>"), lambda done, d: F.when(
        (F.size(done) > 0) & (d["diagonal"] - F.element_at(done, -1)["diagonal"] <= near)
        & (d["diagonal"] - F.element_at(done, -1)["lowest"] <= drift),
        F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
            d["diagonal"].alias("diagonal"), F.least(F.element_at(done, -1)["first"], d["first"]).alias("first"),
            F.greatest(F.element_at(done, -1)["last"], d["last"]).alias("last"),
            F.array_union(F.element_at(done, -1)["seen"], d["seen"]).alias("seen"), F.element_at(done, -1)["lowest"].alias("lowest"))))
    ).otherwise(F.concat(done, F.array(d))))
    share = lambda s: F.size(s["seen"]) / F.col("grams")
    # A phrase stands only where one diagonal has all its runs.
    spans = F.when(F.col("base"), F.filter("diagonals", lambda d: share(d) == 1.0)).otherwise(
        F.filter(merged, lambda s: share(s) >= F.when(F.col("grams") < SHORT, 1.0).otherwise(cover)))
    per_template = found.withColumn("spans", spans).select(
        "doc_id", "content", "n_words", "rows", "label", "base",
        F.size("spans").cast("long").alias("places"),
        F.array_min(F.transform("spans", lambda s: s["first"])).cast("long").alias("first"),
        F.array_max(F.transform("spans", lambda s: s["first"])).cast("long").alias("last"),
        F.array_max(F.transform("spans", share)).alias("share"),
        F.transform("spans", lambda s: F.struct(
            F.col("label").alias("label"), s["first"].alias("first_word"),
            (s["last"] + GRAM - 1).alias("last_word"), share(s).alias("share"))).alias("spans"))
    hit = F.col("places") > 0
    base = hit & F.col("base")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return per_template.groupBy("doc_id", "content").agg(
        F.max("n_words").cast("long").alias("n_words"), F.sum("rows").cast("int").alias("rows"),
        F.coalesce(F.sum(F.when(base, F.col("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("last"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.when(hit, F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    ).drop("content").withColumn("spans", F.sort_array(F.filter("spans", lambda s: s.isNotNull()))).withColumn(
        "rows", F.explode(F.sequence(F.lit(1), "rows"))).drop("rows")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
