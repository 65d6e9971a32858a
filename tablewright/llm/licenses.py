"""License scans in DataFrame functions alone: phrases word by word, notices by an exact set-similarity join.

Words are runs of ``[0-9a-z]`` and of anything beyond ASCII, after A-Z became
a-z.  A phrase counts wherever its words stand consecutively.

The join.  A text becomes blocks of ``2 * span`` words, one every ``span``
words, so whatever runs over at most ``span`` words lies whole in some block.
Of a block only the words of any template matter: its set.  A template meets a
block if the block holds at least ``percent`` hundredths of its distinct words.
All sets are put in one order, words of the fewest blocks first.  Then

* prefix: a block that meets a template of t words, of which it needs c, holds
  one of the template's first t - c + 1 words, and it is among the block's own
  first b - c + 1;
* length: b >= c;
* position: if that word is number i of the template and j of the block (from
  0), at most 1 + min(t - 1 - i, b - 1 - j) words are common from there on; the
  first common word of a block that meets the template passes this with c.

What passes is compared whole.  The filters lose nothing, so every block that
meets a template is found; no block or document is compared with another.
Templates are parameters: their words are literals of the plan, and the index
of prefixes (a row for each word of a prefix) is the only table broadcast; both
are as large as the templates, whatever the input.

Null texts are empty; a text without words has no places, no labels and the
score 0.  Repeated rows give a row each, rows without an id as well.  An empty
table gives an empty result.  Columns besides the two read cannot clash.  A
very long text is many blocks; none is larger than ``2 * span`` words.
"""

from __future__ import annotations

import math
import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.names import bind
from tablewright.llm.common import keyed_texts
from tablewright.operators.staging import stage

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: fixed values: phrases and their labels
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: fixed values: well-known license notices, cut to a sentence or two, and their labels
TEMPLATES = (
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
PERCENT = 80
SPAN = 32


def plain_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(ascii_uppercase, ascii_lowercase)))


def words_of(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    # a text may begin or end between words; splitting takes an eighth of the time that matching words does
    return F.array_remove(F.split(low, BETWEEN), "")


def places_of(words: Column, phrases: tuple[tuple[str, str], ...]) -> Column:
    """(start, label) of every place where the words of a phrase stand consecutively."""
    spaced = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    found = []
    for phrase, label in phrases:
        parts = phrase.split(" ")

        def here(i: Column) -> Column:
            same = words[i] == parts[0]
            for offset, part in enumerate(parts[1:], 1):
                same = same & (F.get(words, i + offset) == part)
            return F.coalesce(same, F.lit(False))

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
        starts = F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label")))
        # most texts hold no phrase; that is known from one look at the whole text
        none = F.array().cast("array<struct<start:bigint,label:string>>")
        found.append(F.when(F.contains(spaced, F.lit(f" {phrase} ")), starts).otherwise(none))
    return F.concat(*found)


def piece_sets(words: Column, vocabulary: list[str], span: int) -> Column:
    """For each ``span`` words the numbers (from 0) of the vocabulary words among them."""
    last = F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / span).cast("int")
    numbered = F.array(*map(F.lit, vocabulary))

    def known(word: Column) -> Column:
        return F.when(word.isin(vocabulary), (F.array_position(numbered, word) - 1).cast("int"))

    def piece(p: Column) -> Column:
        return F.array_distinct(F.array_compact(F.transform(F.slice(words, p * span + 1, F.lit(span)), known)))

    return F.transform(F.sequence(F.lit(0), last), piece)


def block_sets(pieces: Column) -> Column:
    """The sets of blocks, each of a piece and the one after it; a last piece has no block of its own unless it is the only one."""
    blocks = F.sequence(F.lit(0), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.transform(blocks, lambda b: F.array_union(F.get(pieces, b), F.coalesce(F.get(pieces, b + 1), F.array().cast("array<int>"))))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def _as_table(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def meetings(blocks: DataFrame, templates: list[tuple[str, frozenset[int]]], size: int, percent: int) -> DataFrame:
    """``blocks`` (any columns, ``block``, ``held``: numbers under ``size``) that meet a template, with ``label`` and ``share``."""
    counts = dict(blocks.select(F.explode("held").alias("word")).groupBy("word").count().collect())  # ``size`` rows at most
    rank = {word: place for place, word in enumerate(sorted(range(size), key=lambda word: (counts.get(word, 0), word)))}
    needs = [math.ceil(percent * len(held) / 100) for _, held in templates]
    index = []
    for number, ((label, held), need) in enumerate(zip(templates, needs)):
        ordered = sorted(rank[word] for word in held)
        for i, word in enumerate(ordered[: len(ordered) - need + 1]):
            row = {"word": word, "i": i, "template": number, "need": need, "label": label, "ordered": ordered}
            index.append(F.struct(*(F.lit(value).alias(name) for name, value in row.items())))
    ranks = F.array(*(F.lit(rank[word]) for word in range(size)))
    own = [F.col(c) for c in blocks.columns if c != "held"]
    ordered = F.array_sort(F.transform("held", lambda word: F.get(ranks, word))).alias("own")
    long_enough = blocks.where(F.size("held") >= min(needs)).select(*own, ordered)
    prefix = F.slice("own", F.lit(1), F.size("own") - min(needs) + 1)
    probes = long_enough.select(*own, "own", F.posexplode(prefix).alias("j", "word"))
    met = probes.join(F.broadcast(_as_table(blocks, index)), "word")
    most = 1 + F.least(F.size("ordered") - 1 - F.col("i"), F.size("own") - 1 - F.col("j"))
    met = met.where((F.size("own") >= F.col("need")) & (most >= F.col("need")))
    common = F.size(F.array_intersect("own", "ordered"))
    # a pair may pass by several words; its result is the same each time
    return met.where(common >= F.col("need")).select(*own, "label", (common / F.size("ordered")).alias("share"))


def scan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    phrases: tuple[tuple[str, str], ...] = PHRASES,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    percent: int = PERCENT,
    span: int = SPAN,
) -> DataFrame:
    """Per row: doc_id, n_words, places (start, label) of phrases, notices (block, label, share) and score.

    ``notices`` holds every block that meets a template.  The score is 1 where
    a phrase stands, else the largest share of a template that a block holds
    (at least ``percent`` hundredths), else 0.
    """
    cut = [(label, plain_words(notice)) for label, notice in templates]
    if any(not 0 < len(words) <= span for _, words in cut):
        raise ValueError(f"a template has 1 to {span} words")
    vocabulary = sorted({word for _, words in cut for word in words})
    number = {word: i for i, word in enumerate(vocabulary)}
    sets = [(label, frozenset(number[word] for word in words)) for label, words in cut]

    own = keyed_texts(df, key, text)
    # bound, so that a text is cut once and not for each use of its words
    read = bind(own, {"words": words_of(F.col("text"))})
    read = bind(read, {"pieces": piece_sets(F.col("words"), vocabulary, span)}).select(
        "doc_id",
        F.xxhash64(F.lit(13), "doc_id", "text").alias("row"),
        F.size("words").cast("bigint").alias("n_words"),
        places_of(F.col("words"), phrases).alias("places"),
        block_sets(F.col("pieces")).alias("blocks"),
    )
    slim = stage(read, "licenses")
    blocks = slim.select("row", F.posexplode("blocks").alias("block", "held"))
    met = meetings(blocks, sets, len(vocabulary), percent)
    # rows that repeat each other meet the same templates in the same blocks
    best = met.groupBy("row", "block", "label").agg(F.max("share").alias("share"))
    best = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("block", "label", "share"))).alias("notices"))
    none = F.array().cast("array<struct<block:int,label:string,share:double>>")
    joined = slim.drop("blocks").join(best, "row", "left").withColumn("notices", F.coalesce("notices", none))
    held = F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0))
    score = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(held)
    return joined.select("doc_id", "n_words", "places", "notices", score.alias("score"))


def summary(found: DataFrame) -> DataFrame:
    """One flat row for each row of ``scan``."""
    starts = F.transform("places", lambda x: x["start"])
    base = F.transform("places", lambda x: x["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _joined(base).alias("base_labels"),
        _joined(F.concat(base, F.transform("notices", lambda x: x["label"]))).alias("labels"),
        "score",
    )
