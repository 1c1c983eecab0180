"""License scans: an exact set-similarity join of text blocks with license notices, and plain phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tidewater.llm.common import bound_batches, bounded_broadcast
from tidewater.session import checkpointed

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Labels and sentences of public license notices.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the MIT License"),
    ("mit", "licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("public-domain", "This is free and unencumbered software released into the public domain"),
)

#: A word is a run of digits, letters a-z in either case, and bytes beyond ASCII; all else separates words.
WORDS = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Between two sentences: a closing mark and a white space, or an empty line.
SENTENCE_END = r"[.!?][\x09-\x0D\x20]|\n[\x09\x0B-\x0D\x20]*\n"

BLOCKS = "array<struct<start:int,words:int,tokens:array<int>>>"
FOUND = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks {BLOCKS}"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


@dataclass(frozen=True)
class Templates:
    """Notices (label, text) as sets of words, the words numbered, and the share of a notice that a block must contain."""

    notices: Sequence[tuple[str, str]] = NOTICES
    share: Fraction = Fraction(9, 10)

    @cached_property
    def sets(self) -> list[list[bytes]]:
        return [sorted(set(words_of(text.encode()))) for _, text in self.notices]

    @cached_property
    def numbers(self) -> dict[bytes, int]:
        return {word: k for k, word in enumerate(sorted({w for words in self.sets for w in words}))}

    @cached_property
    def needed(self) -> list[int]:
        """Words of each notice that a block must have: its share, rounded up."""
        return [-(-len(words) * self.share.numerator // self.share.denominator) for words in self.sets]

    @cached_property
    def longest(self) -> int:
        """Words of the longest notice, repeats included."""
        return max((len(words_of(text.encode())) for _, text in self.notices), default=1) or 1


def windows(count: int, longest: int) -> Iterator[tuple[int, int]]:
    """Where the blocks of a sentence of `count` words begin and end.

    A sentence is one block up to twice the longest notice; a longer one is cut into blocks of that size that begin
    every `longest` words, so that a run as long as a notice lies whole in one of them.
    """
    if count <= 2 * longest:
        yield 0, count
    else:
        for start in range(0, count - longest, longest):
            yield start, min(count, start + 2 * longest)


def scan_column(text: Column, templates: Templates, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """struct of FOUND for whole texts: words, places of phrases, and the blocks with the notices' words they hold.

    Blocks without a word of any notice are left out, as they can match none.
    """
    numbers, longest = templates.numbers, templates.longest
    spelled = [(b" " + b" ".join(words_of(phrase.encode())) + b" ", label) for phrase, label in phrases]

    def one(text: bytes) -> dict:
        words: list[bytes] = []
        blocks = []
        for sentence in _ENDS.split(text):
            own = sentence.translate(WORDS).split()
            if not numbers.keys().isdisjoint(own):
                for start, end in windows(len(own), longest):
                    tokens = sorted({numbers[w] for w in own[start:end] if w in numbers})
                    if tokens:
                        blocks.append({"start": len(words) + start, "words": end - start, "tokens": tokens})
            words += own
        joined = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in spelled:
            at = joined.find(phrase)
            while at >= 0:
                places.append(joined.count(b" ", 0, at))
                labels.add(label)
                at = joined.find(phrase, at + 1)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": sorted(labels),
            "blocks": blocks,
        }

    kind = T._parse_datatype_string(FOUND)

    @F.arrow_udf(kind)
    def per_batch(texts: pa.Array) -> pa.Array:
        return pa.array([one(t.as_buffer().to_pybytes()) for t in texts.cast(pa.binary())], _ARROW)

    return per_batch(F.coalesce(text, F.lit("")))


def matches(blocks: DataFrame, templates: Templates) -> DataFrame:
    """Rows (row, block, notice, containment) of all blocks that hold enough words of a notice.

    `blocks` has (row, block, tokens): word numbers of a block. Words are ordered by the number of blocks that have them,
    the rarest first. If a block has n words and must share a of them, it shares one of its first n - a + 1 with the
    first |T| - a + 1 of the notice (prefix filter), has a words at least (length filter), and after a shared word at
    places i and j both sides still have enough words (positional filter). Pairs that pass are counted in full.

    Only the words of the notices, which are a parameter, reach the driver, each with its count.
    """
    spark = blocks.sparkSession
    counted = blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()
    times = {r["token"]: r["n"] for r in counted}
    order = sorted(templates.numbers.values(), key=lambda token: (times.get(token, 0), token))
    rank = {token: k for k, token in enumerate(order)}
    prefix, full = [], []
    for notice, (words, needed) in enumerate(zip(templates.sets, templates.needed, strict=True)):
        ranks = sorted(rank[templates.numbers[w]] for w in words)
        full.append((notice, ranks))
        prefix += [(r, notice, place, len(ranks), needed, ranks) for place, r in enumerate(ranks[: len(ranks) - needed + 1]) if needed]
    notices = spark.createDataFrame(prefix, "rank int, notice int, place int, size int, needed int, ranks array<int>")
    if not prefix:
        return blocks.select("row", "block", F.lit(0).alias("notice"), F.lit(0.0).alias("containment")).limit(0)
    ranks = F.array(*(F.lit(rank[token]) for token in range(len(order))))
    ordered = blocks.select(
        "row", "block", F.array_sort(F.transform("tokens", lambda token: F.element_at(ranks, token + 1))).alias("own")
    )
    least = min(needed for needed in templates.needed if needed)
    head = F.slice("own", 1, F.size("own") - least + 1)
    opened = ordered.where(F.size("own") >= least).select("row", "block", "own", F.posexplode(head).alias("at", "rank"))
    left = F.least(F.size("own") - F.col("at"), F.col("size") - F.col("place"))
    passing = (
        opened.join(bounded_broadcast(notices, len(prefix)), "rank")
        .where(F.size("own") >= F.col("needed"))
        .where(F.col("at") <= F.size("own") - F.col("needed"))
        .where(left >= F.col("needed"))
    )
    shared = F.size(F.array_intersect("own", "ranks"))
    return (
        passing.withColumn("shared", shared)
        .where(F.col("shared") >= F.col("needed"))
        .select("row", "block", "notice", (F.col("shared") / F.col("size")).alias("containment"))
        .distinct()
    )


def scan(
    df: DataFrame,
    templates: Templates = Templates(),
    phrases: Sequence[tuple[str, str]] = PHRASES,
    text: str = "text",
    identifier: str = "doc_id",
) -> DataFrame:
    """One row per input row: (identifier, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    `base_labels` and the places (n_base, first_word, last_word) come from `phrases`, `labels` adds those of the notices
    that a block contains, `score` is the largest share of a notice found in a block (0 without one), and `spans` lists
    (notice, start, words, containment) of all such blocks in order. A block is a sentence, or a window of a long one.

    The texts are read once; words, phrases and blocks are written to the shared folder, and all else is done on them.
    A long text is many blocks, each a row of the join; the join's other side is the notices, a row for each word of a
    prefix, whose number is known.

    Null text counts as empty: no word, no label, score 0. Repeated rows, and rows with a null identifier, each give a
    row. Ties do not arise: labels are sorted and distinct. An empty table gives no rows. Other columns are not read.
    """
    bound_batches(df.sparkSession)
    rows = checkpointed(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(identifier).alias("identifier"),
            scan_column(F.col(text), templates, phrases).alias("found"),
        ).select("row", "identifier", "found.*")
    )
    blocks = rows.select("row", F.posexplode("blocks").alias("block", "cell")).select("row", "block", "cell.start", "cell.words", "cell.tokens")
    found = matches(blocks, templates)
    span = F.struct("notice", "block", "containment")
    spans = found.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"), F.max("containment").alias("score"))
    names = F.array(*(F.lit(label) for label, _ in templates.notices)) if templates.notices else F.array(F.lit(""))
    labelled = rows.join(spans, "row", "left")
    own = F.coalesce("found", F.array().cast("array<struct<notice:int,block:int,containment:double>>"))
    block = lambda hit: F.element_at("blocks", hit["block"] + 1)
    listed = F.transform(
        own,
        lambda hit: F.struct(
            hit["notice"].alias("notice"),
            block(hit)["start"].alias("start"),
            block(hit)["words"].alias("words"),
            hit["containment"].alias("containment"),
        ),
    )
    labels = F.array_sort(F.array_union("base_labels", F.transform(own, lambda hit: F.element_at(names, hit["notice"] + 1))))
    return labelled.select(
        F.col("identifier").alias(identifier),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        "base_labels",
        labels.alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        listed.alias("spans"),
    )


_ENDS = re.compile(SENTENCE_END.encode())
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())),
        ("blocks", pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("tokens", pa.list_(pa.int32()))]))),
    ]
)
