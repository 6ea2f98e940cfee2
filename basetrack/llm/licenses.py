"""License scans by an exact set-similarity join.

A text's blocks are runs of ``BLOCK`` consecutive words, each half a block after
the one before, so line breaks play no part and a notice wrapped over lines is
found; every run of half a block's words stands in one of them.  Words are lower
case, ASCII punctuation apart.  A licence template is found where its window, a
``SPREAD`` of its own length in consecutive words, holds at least ``threshold``
of its distinct words; words further apart than that don't count together.
Templates of different labels may have nearly the same words (``need`` and
``window``): more words must be there than a template shares with any of another
label, and one whose words all stand in such a one must stand there whole, with
no word between, so a notice isn't named after a licence it only resembles.

Blocks and templates are joined as sets.  Template words are in one order, by
how many blocks of the whole corpus have them, rarest first.  A block that meets
the threshold must share a word with the template's prefix (all but need - 1 of
its words; need is the least overlap that meets the threshold), so only prefix
words are joined.  Candidates then pass the length filter (the block has need or
more template words), the positional filter (of the words that stand behind the
rarest shared one in that order, the template and the block each have enough
left to reach need) and an exact count over the block.  What is left, few
blocks, is read again for its words in their places, and every window of it is
counted.

Everything is DataFrame expressions.  The index that is broadcast holds the
templates alone, which are a parameter of at most MOST_WORDS words (more are
refused).  Documents are read once for the blocks, which are written, a short
row for each that has a template word, once for the words of the candidates, and
``query`` reads them once more for the base rule; only candidates and one small row for each document are shuffled.

Rows: null texts count as empty; rows with one doc_id and one text are treated
alike and each give a row; a null doc_id stays null; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, sent_if_few, text_or_empty, written

THRESHOLD = 0.85
# words of a block, and how many words may stand between those of a template
BLOCK = 128
SPREAD = 1.2
MOST_WORDS = 100_000
NO_ID = -(1 << 63)

# Phrases of the base rule and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Short notices of public licences and their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
]

BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_in(text: str) -> list[str]:
    """Words of a template, which is ASCII, in their order."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_words(text: str) -> list[str]:
    """Distinct words of a template."""
    return sorted(set(words_in(text)))


def shared_with_others(text: str, templates: list[tuple[str, str]] = TEMPLATES) -> int:
    """The most distinct words that a template has in common with one of another label."""
    own, labels = set(words_in(text)), {label for label, t in templates if t == text}
    return max((len(own.intersection(words_in(t))) for label, t in templates if label not in labels), default=0)


def window(text: str, templates: list[tuple[str, str]] = TEMPLATES) -> int:
    """How many consecutive words of a text a template's words may take."""
    n = len(words_in(text))
    return n if shared_with_others(text, templates) == len(template_words(text)) else math.ceil(SPREAD * n)


def need(text: str, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> int:
    """How many distinct words of a template make a find."""
    n = len(template_words(text))
    return min(n, max(math.ceil(n * threshold - 1e-9), shared_with_others(text, templates) + 1))


def _spaces(x: Column) -> Column:
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit("")))


def base(docs: DataFrame) -> DataFrame:
    """(row_id, row_text, n_words, n_base, first_word, last_word, base_labels as an array) of every row."""
    # every word with a space on either side, so that neighbouring phrases share none
    plain = F.trim(F.regexp_replace(text_or_empty(), BREAK, "  "))
    rows = docs.select(*_key(), plain.alias("plain"))
    rows = rows.select("row_id", "row_text", F.when(F.col("plain") == "", F.lit("")).otherwise(F.concat(F.lit(" "), "plain", F.lit(" "))).alias("plain"))
    rows = rows.withColumn("n_words", (_spaces(F.col("plain")) / 2).cast("long"))
    maybe = F.col("plain").rlike("(?i) license ")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        name = f"_parts_{label}"
        pattern = "(?i) " + phrase.replace(" ", "  ") + " "
        rows = rows.withColumn(name, F.when(maybe, F.split("plain", pattern, -1)))
        parts = F.col(name)
        n = F.coalesce(F.size(parts) - 1, F.lit(0)).cast("long")
        n = F.when(parts.isNull(), F.lit(0).cast("long")).otherwise(n)
        counts.append(n)
        firsts.append(F.when(n > 0, (_spaces(F.get(parts, F.lit(0))) / 2).cast("long")))
        lasts.append(F.when(n > 0, F.col("n_words") - (_spaces(F.element_at(parts, -1)) / 2).cast("long") - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    return rows.select(
        "row_id",
        "row_text",
        "n_words",
        sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*firsts).alias("first_word"),
        F.greatest(*lasts).alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base_labels"),
    )


def _key() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("row_id"), F.xxhash64("text").alias("row_text")


def _words() -> Column:
    """All words of a text, in lower case."""
    # the two letters beyond ASCII whose lower case has an ASCII letter stay apart
    text = F.regexp_replace(text_or_empty(), "[\u0130\u212a]", "\u026a")
    return F.split(F.trim(F.lower(F.regexp_replace(text, BREAK, " "))), " ")


def blocks(docs: DataFrame, templates: list[tuple[str, str]], size: int = BLOCK) -> DataFrame:
    """(row_id, row_text, block, words): the distinct template words of each block that has any, in the block's order."""
    vocabulary = F.array(*map(F.lit, sorted({w for _, text in templates for w in template_words(text)})))
    step = size // 2
    rows = docs.select(*_key(), _words().alias("words"))
    n = F.greatest(F.ceil(F.size("words") / step) - 1, F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_intersect(F.slice("words", i * step + 1, size), vocabulary))
    rows = rows.select("row_id", "row_text", F.posexplode(parts).alias("block", "words"))
    return rows.where(F.size("words") > 0)


def found(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, row_text, block, template, label, containment) of every block and template that meet the threshold; containment: of its best window."""
    spark = docs.sparkSession
    if sum(len(words_in(text)) for _, text in templates) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words are too many to broadcast")
    size = max([BLOCK, *(2 * window(text, templates) for _, text in templates)])
    rows = written(blocks(docs, templates, size), "license-blocks")
    # a row for each template word at most
    counted = rows.select(F.explode("words").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counted.collect()}
    rare_first = lambda words: sorted(words, key=lambda w: (frequency.get(w, 0), w))
    order = F.array(*map(F.lit, rare_first({w for _, text in templates for w in words_in(text)})))
    prefixes = []
    for i, (label, text) in enumerate(templates):
        of, least = rare_first(template_words(text)), need(text, threshold, templates)
        prefixes += [(i, label, least, window(text, templates), of, place, of[place]) for place in range(len(of) - least + 1)]
    index = spark.createDataFrame(prefixes, "template int, label string, need int, window int, of array<string>, place int, word string")
    probes = rows.select("row_id", "row_text", "block", "words", F.explode("words").alias("word"))
    met = probes.join(F.broadcast(index), "word").where("size(words) >= need")
    met = met.groupBy("row_id", "row_text", "block", "template").agg(F.min("place").alias("place"), *[F.first(c).alias(c) for c in ("words", "of", "need", "window", "label")])
    # place: of the rarest shared word in the template; in the block it is that among its own words in the same order
    met = met.withColumn("sorted", F.array_intersect(order, "words"))
    in_block = F.array_position("sorted", F.get("of", F.col("place"))) - 1
    met = met.where((F.size("of") - F.col("place") >= F.col("need")) & (F.size("sorted") - in_block >= F.col("need")))
    met = checkpointed(met.where(F.size(F.array_intersect("words", "of")) >= F.col("need")).drop("place", "words", "sorted"))
    # the blocks that are left, with their words in place
    texts = sent_if_few(met.select("row_id", "row_text").distinct())
    placed = docs.select(*_key(), "text").join(texts, ["row_id", "row_text"]).groupBy("row_id", "row_text").agg(F.min("text").alias("text"))
    placed = met.join(placed.select("row_id", "row_text", _words().alias("all")), ["row_id", "row_text"])
    placed = placed.select(*met.columns, F.slice("all", F.col("block") * (size // 2) + 1, size).alias("own"))
    starts = F.filter(F.sequence(F.lit(1), F.size("own")), lambda i: F.array_contains("of", F.get("own", i - 1)))
    overlap = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice("own", i, F.col("window")), "of"))))
    placed = placed.withColumn("overlap", overlap).where("overlap >= need")
    return placed.select("row_id", "row_text", "block", "template", "label", (F.col("overlap") / F.size("of")).alias("containment"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each row of ``docs``.

    score is the largest containment of a template found, 1 where a phrase of
    the base rule stands and 0 where nothing is found.
    """
    hits = found(docs).groupBy("row_id", "row_text").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    rows = base(docs).join(hits, ["row_id", "row_text"], "left")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return rows.select(
        F.when(F.col("row_id") != NO_ID, F.col("row_id")).alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
