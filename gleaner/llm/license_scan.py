"""License scan by diagonal voting.

Every rolling window of words of every text is hashed and joined with the
windows of the license templates. A match votes for the diagonal (place in the
text minus place in the template) on which a copy of the template would lie, if
its words are those of the template's window: hashes only find candidates. A
diagonal with the most votes within ``DRIFT`` words either way takes in its
neighbours, so that a few inserted or missing words don't split a copy, and a
span counts if the verified windows cover at least ``LEAST`` of the template's
words. All of it is native: the templates are a broadcast table of a few hundred
windows, and texts are read once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.operators.storage import materialize

from .common import ascii_lower, let, table

#: Words of a window; templates of at most ``SHORT`` words take the smaller, so that one edit leaves windows enough.
GRAM, SMALL_GRAM, SHORT = 5, 2, 12
DRIFT = 3
LEAST = 0.8
#: Fixed values of the contract: phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Passages of public licenses and of the notices that name them, each of five words or more.
TEMPLATES = [
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words_of(text: Column) -> Column:
    """A-Z in lower case, then the runs of 0-9, a-z and code points from U+0080."""
    lower = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(hashes: Column, k: int) -> Column:
    """Hash of the k word hashes from each place on; empty for fewer than k words."""
    return F.when(
        F.size(hashes) >= k,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))),
    ).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """(h, k, gram, template, label, place, length): the windows of the templates, one row for each."""
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), words_of(F.lit(t)).alias("words"))
            for i, (label, t) in enumerate(templates)
        )
    )
    n, k = F.size("words"), F.when(F.size("words") <= SHORT, F.lit(SMALL_GRAM)).otherwise(F.lit(GRAM))
    hashes = F.transform("words", lambda w: F.xxhash64(w))
    each = spark.range(1).select(F.inline(rows)).select(
        "template", "label", "words", n.alias("length"), k.alias("k"),
        F.posexplode(F.when(k == GRAM, gram_hashes(hashes, GRAM)).otherwise(gram_hashes(hashes, SMALL_GRAM))).alias("place", "h"),
    )
    return each.withColumn("gram", _window("words", "place", "k")).drop("words")


def _window(words: str, start: str, k: str) -> Column:
    return F.array_join(F.slice(F.col(words), F.col(start) + 1, F.col(k)), " ")


def read_texts(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """One pass over the texts: for each row of ``docs`` one row with ``base`` and, for each window that stands in a
    template as well, one row with its places and a null ``base``.

    ``version`` is a hash of the text. Equal hashes of other words are dropped here.
    """

    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        # the last one is no window and stands for the text itself
        windows = let(hashes, lambda h: F.concat(gram_hashes(h, GRAM), gram_hashes(h, SMALL_GRAM), F.array(F.lit(None).cast("bigint"))))
        return F.struct(words.alias("words"), _base(words).alias("base"), windows.alias("windows"))

    texts = docs.select(
        "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), let(words_of(F.col("text")), of_words).alias("t")
    ).select("doc_id", "version", "t.words", "t.base", F.posexplode("t.windows").alias("at", "h"))
    n = F.size("words")
    large = F.greatest(n - GRAM + 1, F.lit(0))
    own = F.col("at") == large + F.greatest(n - SMALL_GRAM + 1, F.lit(0))
    k = F.when(F.col("at") < large, F.lit(GRAM)).otherwise(F.lit(SMALL_GRAM))
    placed = texts.select(
        "doc_id", "version", "words", "base", "h", own.alias("own"),
        k.alias("wide"), F.when(F.col("at") < large, F.col("at")).otherwise(F.col("at") - large).alias("at"),
    )
    met = placed.join(F.broadcast(grams), "h", "left")  # the templates are a constant of this module
    same = (F.col("k") == F.col("wide")) & (F.col("gram") == _window("words", "at", "wide"))
    return met.where(F.col("own") | same).select(
        "doc_id", "version", "template", "label", "length", "k", "place", "at", F.when(F.col("own"), F.col("base")).alias("base")
    )


def spans_of(votes: DataFrame) -> DataFrame:
    """(doc_id, version, template, label, first, last, share): copies of templates, in words from 0.

    Repeated votes count once. Of diagonals with equally many votes within reach, the smallest is the anchor.
    """
    key = ["doc_id", "version", "template", "label", "length", "k"]
    diagonals = votes.groupBy(*key, (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.collect_set("place").alias("places")
    )
    near = Window.partitionBy("doc_id", "version", "template").orderBy("diagonal").rangeBetween(-DRIFT, DRIFT)
    strength = F.struct(F.size("places"), -F.col("diagonal"))
    merged = diagonals.select(
        *key,
        (F.max(strength).over(near) == strength).alias("anchor"),
        F.min("first").over(near).alias("first"),
        (F.max("last").over(near) + F.col("k") - 1).alias("last"),
        F.flatten(F.collect_list("places").over(near)).alias("places"),
    ).where("anchor")
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + F.col("k") - 1))))
    )
    return (
        merged.withColumn("share", covered / F.col("length"))
        .where(F.col("share") >= LEAST)
        .select("doc_id", "version", "template", "label", "first", "last", "share")
    )


def license_spans(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """Copies of templates in the texts of (doc_id, text), as of ``spans_of``; repeated rows count once."""
    grams = template_grams(docs.sparkSession, TEMPLATES if templates is None else templates)
    return spans_of(read_texts(docs, grams).where("template is not null"))


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    none = F.array().cast("array<int>")
    found = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(parts)),
        lambda i: reduce(and_, (F.get(words, i + k) == p for k, p in enumerate(parts))),
    )
    near = (F.size(words) >= len(parts)) & F.contains(F.array_join(words, " "), F.lit(phrase))
    return F.when(near, found).otherwise(none)


def _base(words: Column) -> Column:
    """Struct of the word count and, for the fixed phrases, number, first and last place and labels."""
    per_phrase = F.array(*(_phrase_starts(words, p) for p in BASE_PHRASES))

    def of_places(each: Column) -> Column:
        starts = F.flatten(each)
        labels = F.array_compact(
            F.array(*(F.when(F.size(F.get(each, F.lit(i))) > 0, F.lit(v)) for i, v in enumerate(BASE_PHRASES.values())))
        )
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.size(starts).cast("bigint").alias("n_base"),
            F.array_min(starts).cast("bigint").alias("first_word"),
            F.array_max(starts).cast("bigint").alias("last_word"),
            F.array_sort(F.array_distinct(labels)).alias("found"),
        )

    return let(per_phrase, of_places)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: word count, fixed phrases, labels of phrases and spans, and a score.

    ``score`` is 1 where a fixed phrase stands, else the largest share of a
    template that a span covers, else 0. A null or empty text has no words. Very
    long texts are read whole. Repeated rows give repeated results; rows without
    doc_id are scanned like any other; an empty table gives an empty one. Further
    columns of ``docs``, whatever their names, are not read.
    """
    grams = template_grams(docs.sparkSession, TEMPLATES if templates is None else templates)
    read = materialize(read_texts(docs, grams), "votes")
    spans = (
        spans_of(read.where("template is not null"))
        .groupBy(F.col("doc_id").alias("span_id"), F.col("version").alias("span_version"))
        .agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    )
    base = read.where("template is null").select("doc_id", "version", "base.*")
    met = F.col("doc_id").eqNullSafe(F.col("span_id")) & (F.col("version") == F.col("span_version"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("found", F.coalesce("more", none)))
    return base.join(spans, met, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("found", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and spans of every document, one row for each row."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
