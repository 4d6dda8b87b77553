"""Operator 7, license scans by diagonal voting; DataFrame functions only.

All rolling word k-gram hashes of a document are joined to their positions in
license templates.  A pair votes for the diagonal (position in the document
less position in the template); votes are summed by diagonal, neighbouring
diagonals are merged, and each merged span is verified against its template.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table
from .native import bind, rolling_hashes

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Passages of public licenses.
TEMPLATES = {
    "agpl": ("it under the terms of the gnu affero general public license as published by the free software foundation", "licensed under the gnu affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "you may obtain a copy of the license at http www apache org licenses license 2 0", "you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    "artistic-2.0": ("this program is free software you can redistribute it and or modify it under the terms of the artistic license",),
    "boost-1.0": ("distributed under the boost software license version 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "cc-by": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",),
    "cddl": ("the contents of this file are subject to the terms of the common development and distribution license",),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license", "licensed under the eclipse public license"),
    "gpl": (
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
    ),
    "lgpl": ("it under the terms of the gnu lesser general public license as published by the free software foundation", "licensed under the gnu lesser general public license"),
    "mit": (
        "released under the mit license", "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",),
}

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def license_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, A to Z in lower case."""

    def split(t: Column) -> Column:
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(F.split(F.translate(t, ascii_uppercase, ascii_lowercase), " "))

    return bind(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SEPARATORS, " ")), split)


def template_grams(spark: SparkSession, templates: dict[str, tuple[str, ...]], k: int) -> DataFrame:
    """label, template, t_grams, t_pos and h of every k-gram of the templates: a few hundred rows, whatever the input."""
    rows = [(label, f"{label}/{i}", text.split(" ")) for label, texts in templates.items() for i, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "label string, template string, words array<string>")
    return made.select("label", "template", (F.size("words") - k + 1).alias("t_grams"), F.posexplode(rolling_hashes(F.col("words"), k)).alias("t_pos", "h"))


def license_spans(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, *, k: int = 3, slack: int = 2, coverage: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Verified spans: doc_id, text_hash, label, template, first_word, last_word, coverage.

    Diagonals no more than ``slack`` apart are one span.  A span is verified if
    it holds at least ``coverage`` of the template's k-grams and is no longer
    than the template by more than half.  Null and empty texts have no spans.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), license_words(F.col(text_column)).alias("words"))
    rolled = base.where(F.size("words") >= k).select("doc_id", "text_hash", F.posexplode(rolling_hashes(F.col("words"), k)).alias("pos", "h"))
    grams = template_grams(docs.sparkSession, templates, k)
    votes = rolled.join(F.broadcast(grams), "h").withColumn("diagonal", F.col("pos") - F.col("t_pos"))  # bounded by the templates
    # what a diagonal holds is bounded by its template, so its sets are small
    lines = votes.groupBy("doc_id", "text_hash", "label", "template", "t_grams", "diagonal").agg(F.collect_set("t_pos").alias("seen"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    along = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(along) > slack).cast("int"), F.lit(0))
    lines = lines.withColumn("apart", apart).withColumn("span", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy("doc_id", "text_hash", "label", "template", "t_grams", "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = (F.col("n") / F.col("t_grams")).alias("coverage")
    out = merged.select("doc_id", "text_hash", "label", "template", F.col("first").cast("long").alias("first_word"), (F.col("last") + k - 1).cast("long").alias("last_word"), share, "t_grams")
    return out.where((F.col("coverage") >= coverage) & (F.col("last_word") - F.col("first_word") + 1 <= 1.5 * (F.col("t_grams") + k - 1))).drop("t_grams")


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES, *, id_column: str = "doc_id", text_column: str = "text", **spans) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base columns are about the phrases; ``labels`` adds those of verified
    spans.  score is the best coverage of a span, and 0.5 at least where a
    phrase stands.  A null text is empty; a null id is an id like any other
    here; rows equal in id and text get the same row each.
    """
    any_phrase = "(?: (?:" + "|".join(phrases) + ")(?= ))"
    base = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), license_words(F.col(text_column)).alias("words"))
    base = base.select("doc_id", "text_hash", F.size("words").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("line"))

    def facts(line: Column) -> Column:
        n = F.regexp_count(line, F.lit(any_phrase)).cast("long")
        spaces = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
        first = spaces(F.regexp_extract(line, f"(?s)^(.*?){any_phrase}", 1)).cast("long")
        last = spaces(F.regexp_extract(line, f"(?s)^(.*){any_phrase}", 1)).cast("long")
        labels = F.array_compact(F.array(*[F.when(F.instr(line, f" {p} ") > 0, F.lit(label)) for p, label in sorted(phrases.items(), key=lambda x: x[1])]))
        none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("labels"))
        return F.when(n > 0, F.struct(n.alias("n"), first.alias("first"), last.alias("last"), labels.alias("labels"))).otherwise(none)

    base = base.select("doc_id", "text_hash", "n_words", bind(F.col("line"), facts).alias("b"))
    found = license_spans(docs, templates, id_column=id_column, text_column=text_column, **spans)
    found = found.groupBy(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2")).agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    both = base.join(found, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("text_hash") == F.col("hash2")), "left")
    labels = F.array_sort(F.array_union("b.labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.col("b.n") > 0, 0.5).otherwise(0.0))
    return both.select(
        "doc_id", "n_words", F.col("b.n").alias("n_base"), F.col("b.first").alias("first_word"), F.col("b.last").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("b.labels")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.round(F.least(score, F.lit(1.0)), 6).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
