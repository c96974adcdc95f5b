"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license notices.

A block is a line of a document, a notice a set of words; they join when the block holds at least
``CONTAINED`` of the notice's words. Words are put in one global order, rarest first, by the number of
documents of the whole corpus that hold them. A notice of ``t`` words that needs ``o`` of them in a block

* prefix: meets the block in one of its first ``t - o + 1`` words, and there within the first ``b - o + 1``
  of the block's ``b`` words that occur in notices at all;
* length: needs ``b >= o``;
* position: at a match in position ``i`` of the notice and ``j`` of the block at most
  ``1 + min(t - i, b - j)`` words are shared from there on, positions counted from 1.

What passes is verified by intersecting the sets, so the result is exact. Notices are an argument of
bounded number, so their prefixes are sent to all tasks; documents are read in place, and only blocks
that hold a word of some prefix are looked at any further.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cashtide.llm.tables import written
from cashtide.llm.url_filter import LOWER, UPPER

#: What parts words: ASCII apart from digits and lower-case letters. A fixed value of the contract.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

CONTAINED = 0.8

#: Their prefixes are broadcast.
MAX_NOTICES = 2_000

#: Phrases and their labels: fixed values of the contract.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Opening sentences of public license notices and their labels: fixed values.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]


@dataclass(frozen=True)
class Notice:
    """A notice as a set of words, of which a block must hold ``needed``."""

    label: str
    words: tuple[str, ...]
    needed: int

    @staticmethod
    def of(label: str, text: str, threshold: float) -> Notice:
        words = tuple(sorted(set(text.split())))
        return Notice(label, words, max(1, math.ceil(threshold * len(words) - 1e-9)))


def folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def spaced(text: Column) -> Column:
    """The words of folded text, one blank between them and at either end; one blank if there are none."""
    return F.regexp_replace(F.concat(F.lit(" "), text, F.lit(" ")), BREAKS, " ")


def starts_of(spaced_text: Column, words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase stands; words are only looked through where it occurs."""
    parts = phrase.split(" ")

    def places(held: Column) -> Column:
        here = lambda i: _all(F.get(held, i + F.lit(k)) == F.lit(part) for k, part in enumerate(parts))
        return F.filter(F.sequence(F.lit(0), F.size(held) - F.lit(len(parts))), here)

    # As the variable of a transform the words are split once, not for every place.
    found = F.transform(F.array(words), places)[0]
    none = F.expr("cast(array() as array<int>)")
    return F.when(F.contains(spaced_text, F.lit(f" {phrase} ")), found).otherwise(none)


def _all(conditions) -> Column:
    met = F.lit(True)
    for condition in conditions:
        met = met & condition
    return met


def global_order(docs_words: DataFrame, vocabulary: list[str]) -> list[str]:
    """Words of notices, rarest first, by the number of documents that hold them (``words`` of each document)."""
    known = F.array(*map(F.lit, vocabulary))
    held = docs_words.select(F.explode(F.array_intersect("words", known)).alias("word"))
    counts = dict(held.groupBy("word").count().collect())  # at most one row per word of the notices
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_of(notice: Notice, order: list[str]) -> list[str]:
    """The rarest words of a notice, one of which every joining block holds."""
    return [w for w in order if w in notice.words][: len(notice.words) - notice.needed + 1]


def may_join(words: Column, order: list[str], notices: list[Notice]) -> Column:
    """Whether the words have any of a prefix; what has none joins no notice."""
    return F.arrays_overlap(words, F.array(*map(F.lit, sorted({w for n in notices for w in prefix_of(n, order)}))))


def join_notices(blocks: DataFrame, order: list[str], notices: list[Notice]) -> DataFrame:
    """The similarity join: ``blocks`` (any columns and ``words``) with ``label`` and ``containment``."""
    if len(notices) > MAX_NOTICES:
        raise ValueError(f"at most {MAX_NOTICES} notices")
    rank = {word: i for i, word in enumerate(order)}
    prefixes = [
        (rank[word], at, len(n.words), n.needed, n.label, sorted(rank[w] for w in n.words))
        for n in notices
        for at, word in enumerate(prefix_of(n, order), 1)
    ]
    spark = blocks.sparkSession
    heads = spark.createDataFrame(
        prefixes, "word int, i int, t int, needed int, label string, members array<int>"
    )
    ranks = F.create_map(*(x for word in order for x in (F.lit(word), F.lit(rank[word]))))
    in_order = F.sort_array(F.transform(F.array_intersect("words", F.array(*map(F.lit, order))), lambda w: ranks[w]))
    ranked = blocks.where(may_join(F.col("words"), order, notices)).withColumn("ranked", in_order).withColumn("b", F.size("ranked"))
    least = min(n.needed for n in notices)
    heads_of_blocks = ranked.where(F.col("b") >= least).select(
        "*", F.posexplode(F.slice("ranked", 1, F.col("b") - F.lit(least - 1))).alias("j", "word")
    )
    met = heads_of_blocks.join(F.broadcast(heads), "word").where(
        (F.col("b") >= F.col("needed"))
        & (F.col("j") + 1 <= F.col("b") - F.col("needed") + 1)
        & (1 + F.least(F.col("t") - F.col("i"), F.col("b") - F.col("j") - 1) >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("ranked", "members"))
    return met.where(shared >= F.col("needed")).withColumn("containment", shared / F.col("t"))


def scan(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    notices: list[tuple[str, str]] | None = None,
    threshold: float = CONTAINED,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of phrases, also overlapping ones; ``first_word`` and ``last_word`` are null
    without any. ``labels`` has those of the phrases and those of joined notices. The score is 1 with a phrase, else the
    highest containment of a joined notice, else 0. Null and empty texts have no words and no labels. Repeated
    rows give equal rows. Other columns are ignored.
    """
    phrases = PHRASES if phrases is None else phrases
    known = [Notice.of(label, text, threshold) for label, text in (NOTICES if notices is None else notices)]
    vocabulary = sorted({w for n in known for w in n.words})
    text = folded(F.col("text"))
    read = docs.select("doc_id", F.xxhash64("text").alias("hash"), text.alias("text"))
    order = global_order(read.select(F.split(spaced(F.col("text")), " ").alias("words")), vocabulary)

    near = may_join(F.split(spaced(F.col("text")), " "), order, known)
    lines = read.where(near).select("doc_id", "hash", F.explode(F.split("text", "\n")).alias("line"))
    blocks = lines.select("doc_id", "hash", F.split(spaced(F.col("line")), " ").alias("words"))
    hits = join_notices(blocks, order, known)
    found = hits.groupBy("doc_id", "hash").agg(
        F.collect_set("label").alias("notice_labels"), F.max("containment").alias("best")
    )

    # Exploding an array of one keeps the text from being spaced anew for every column that uses it.
    spans = read.select("doc_id", "hash", F.explode(F.array(spaced(F.col("text")))).alias("spaced"))
    words = F.split(F.trim("spaced"), " ")
    starts = {phrase: starts_of(F.col("spaced"), words, phrase) for phrase in phrases}
    counted = spans.select(
        "doc_id",
        "hash",
        # A blank stands before every word and one after the last.
        (F.length("spaced") - F.length(F.replace("spaced", F.lit(" "), F.lit(""))) - 1).cast("long").alias("n_words"),
        F.concat(*starts.values()).alias("starts"),
        F.array_compact(
            F.array(*(F.when(F.contains("spaced", F.lit(f" {p} ")), F.lit(label)) for p, label in phrases.items()))
        ).alias("base"),
    )
    found = found.withColumnsRenamed({"doc_id": "_doc_id", "hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("hash") == F.col("_hash"))
    none = F.expr("cast(array() as array<string>)")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("notice_labels", none))))
    return counted.join(found, same, "left").select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def scan_blocks(docs: DataFrame, notices: list[tuple[str, str]] | None = None, threshold: float = CONTAINED) -> DataFrame:
    """The joined pairs themselves, stored: doc_id, line, label, containment, for every block of ``docs``."""
    known = [Notice.of(label, text, threshold) for label, text in (NOTICES if notices is None else notices)]
    vocabulary = sorted({w for n in known for w in n.words})
    read = docs.select("doc_id", folded(F.col("text")).alias("text"))
    order = global_order(read.select(F.split(spaced(F.col("text")), " ").alias("words")), vocabulary)
    lines = read.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "block"))
    blocks = lines.select("doc_id", "line", F.split(spaced(F.col("block")), " ").alias("words"))
    pairs = join_notices(blocks, order, known).groupBy("doc_id", "line", "label").agg(F.max("containment").alias("containment"))
    return written(pairs, "license-blocks")
