"""License notices by diagonal voting over word k-grams, besides fixed phrases.

Every rolling K-gram of a document's words is hashed and joined with the templates' K-grams. A hit lies on a diagonal
(document position less template position); hits are gathered per document, template and diagonal, neighbouring diagonals
(an inserted or missing word shifts the rest by one) are merged, and a merged span is verified: it must cover COVERED of
the template's K-grams and not be spread wider than the template and SPREAD words.

Native, in one reading of the texts: the base result of a document rides along as one more entry of its K-gram list, so
that documents without hits need no second reading. Only hits are shuffled. The templates' table is a fixed small one.

Defined results: null text has no words, no labels and score 0; rows that repeat a doc_id are told apart by their text,
and equal rows give equal results; spans that tie give their labels alike; an empty table gives no rows; other columns than
doc_id and text are not looked at; a long text takes time in proportion to its words and hits.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import positioned_words, stored, upto

#: The contract's phrases and labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Public notices in their usual wording (fixed values).
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.",),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
}
K, NEIGHBOURS, COVERED, SPREAD = 3, 3, 0.6, 6
#: Score of a document whose labels come from a phrase alone.
PHRASE_SCORE = 0.9
#: The template number of a document's base entry.
BASE = -1


def _words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", text.lower())


def templates(spark: SparkSession) -> DataFrame:
    """template, label, n_grams, place, gram (hash)."""
    rows = []
    for number, (label, text) in enumerate((label, t) for label, texts in TEMPLATES.items() for t in texts):
        words = _words(text)
        rows += [(number, label, len(words) - K + 1, i, words[i : i + K]) for i in range(len(words) - K + 1)]
    grams = spark.createDataFrame(rows, "template int, label string, n_grams int, place int, words array<string>")
    return grams.withColumn("gram", F.xxhash64(*[F.get("words", F.lit(i)) for i in range(K)])).drop("words")


def phrases_in(text: Column, words: Column, at: Column, n: Column) -> Column:
    """(start, label) of every place where a phrase's words stand consecutively; looked for only where they may."""
    may = F.contains(F.lower(text), F.lit("license")) | text.rlike(r"(?i)(?<![0-9a-z\x{80}-\x{10FFFF}])cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by(?![0-9a-z\x{80}-\x{10FFFF}])")

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        stands = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + at + j) == p for j, p in enumerate(parts)])
        return F.transform(F.filter(upto(n - len(parts) + 1), stands), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))

    kind = "array<struct<start:int,label:string>>"
    return F.when(may, F.concat(*[places(p, label) for p, label in PHRASES])).otherwise(F.array()).cast(kind)


def entries(docs: DataFrame) -> DataFrame:
    """Stored hits (template, place, position) of every document, and one BASE entry each with its base result."""
    spark = docs.sparkSession
    rows = positioned_words(docs, F.col("text"))
    rows = rows.select("doc_id", "text_key", "words", "at", "n_words", phrases_in(F.col("text"), F.col("words"), F.col("at"), F.col("n_words")).alias("base"))
    rows = rows.withColumn("last_gram", F.greatest(F.lit(-1), F.col("n_words") - K))
    each = rows.select("doc_id", "text_key", "words", "at", "n_words", "base", F.explode(F.sequence(F.lit(-1), F.col("last_gram"))).alias("i"))
    word = lambda j: F.get("words", F.col("i") + F.col("at") + j)
    gram = F.when(F.col("i") >= 0, F.xxhash64(*[word(j) for j in range(K)])).otherwise(F.lit(BASE).cast("long"))
    known = templates(spark).select("template", "place", "gram").unionByName(spark.createDataFrame([(BASE, 0, BASE)], "template int, place int, gram long"))
    hits = each.withColumn("gram", gram).join(F.broadcast(known), "gram")  # a fixed table of a few hundred rows
    of_base = lambda c: F.when(F.col("template") == BASE, c)
    return stored(hits.select("doc_id", "text_key", "template", "place", F.col("i").alias("position"), of_base(F.col("n_words")).alias("n_words"), of_base(F.col("base")).alias("base")))


def spans(found: DataFrame) -> DataFrame:
    """doc_id, text_key, label, coverage, first, last for every verified span."""
    known = templates(found.sparkSession).select("template", "label", "n_grams").distinct()
    hits = found.where(F.col("template") != BASE)
    key = ["doc_id", "text_key", "template"]
    # places on one diagonal are at most the template's K-grams
    voted = hits.groupBy(*key, (F.col("position") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("position").alias("first"), F.max("position").alias("last"))
    by_diagonal = Window.partitionBy(*key).orderBy("diagonal")
    fresh = F.when(F.col("diagonal") - F.lag("diagonal").over(by_diagonal) <= NEIGHBOURS, 0).otherwise(1)
    merged = voted.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(by_diagonal))
    joined = merged.groupBy(*key, "group").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    coverage = F.size("places") / F.col("n_grams")
    held = (coverage >= COVERED) & (F.col("last") - F.col("first") < F.col("n_grams") + SPREAD)
    return joined.join(F.broadcast(known), "template").where(held).select("doc_id", "text_key", "label", coverage.alias("coverage"), "first", (F.col("last") + K - 1).alias("last"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: words, phrase places, labels of phrases and of all, score."""
    found = entries(docs)
    base = found.where(F.col("template") == BASE).select("doc_id", "text_key", "n_words", "base").alias("b")
    more = spans(found).groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage")).alias("m")
    same = F.col("b.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("b.text_key") == F.col("m.text_key"))
    starts, own = F.transform("base", lambda p: p["start"]), F.transform("base", lambda p: p["label"])
    every = F.concat(own, F.coalesce("more", F.array().cast("array<string>")))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    score = F.greatest(F.coalesce("coverage", F.lit(0.0)), F.when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0))
    return base.join(more, same, "left").select(
        "b.doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"), joined(every).alias("labels"), score.alias("score"),
    )
