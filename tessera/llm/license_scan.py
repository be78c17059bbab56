"""License scans: an exact set-similarity join of text blocks with license templates.

All DataFrame functions. Tokens of the templates are put in one global order, the
rarest in the corpus first. A block that holds a template to the threshold shares a
token of the template's prefix in that order, has enough tokens, and leaves room
for the rest behind the shared token in both lists; what passes these filters is
counted exactly. A block is any window of twice a stride of words, wherever it starts,
and a stride has the words of the longest template. Windows that start in the same
stride lie in one stretch of three, which is filtered and counted first; only where a
stretch holds enough tokens are its windows counted, one for each place of a token of
the template. The template side is a short fixed list, so its index is part of the
plan and the texts are not shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names

#: The least words of a stride, and the share of a template's distinct words that a block must hold.
STRIDE, THRESHOLD = 32, 0.8
#: Phrases whose words must stand one after another, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: License notices and their labels.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "released under the terms of the creative commons attribution license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, in text of either case.
_GAP, _WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def stride_of(templates=TEMPLATES) -> int:
    return max([STRIDE, *(len(text.split()) for _, text in templates)])


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, _GAP), lambda w: w != "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def token_order(df: DataFrame, templates, text_col: str = "text") -> list[str]:
    """The templates' tokens, the rarest in the corpus first; ties by code point. One row for each reaches the driver."""
    own = sorted({t for _, text in templates for t in text.split()})
    words = df.select(F.split(F.lower(F.col(text_col)), _GAP).alias("w")).select(F.explode(F.filter("w", lambda w: w.isin(own))).alias("t"))
    counts = {r["t"]: r["n"] for r in words.groupBy("t").agg(F.count("*").alias("n")).collect()}
    return sorted(own, key=lambda t: (counts.get(t, 0), t))


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    spots = F.when(F.size(words) >= len(parts), F.sequence(F.lit(0), F.size(words) - len(parts))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        ok = words[i] == parts[0]
        for k, part in enumerate(parts[1:], 1):
            ok = ok & (words[i + k] == part)
        return ok

    return F.filter(spots, here)


def scan(df: DataFrame, text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without its text, with n_words, n_base, first_word, last_word (long), base_labels, labels and score.

    base_labels: of the phrases whose words stand one after another; labels: those
    and the templates held to ``threshold`` by a block, both distinct, sorted and
    comma-joined (empty if none); where in the text a passage starts makes no difference. score: 1 with a base label, else the largest
    containment that reached the threshold, else 0. Templates may have any length.
    Defined cases: a null text is empty: no words, no places, no labels; texts count
    whole; each row is judged by itself, so repeated rows and ids give repeated
    results; of templates with one label the best counts; an empty table gives no
    rows. Columns of these names in ``df`` are replaced, others stay whatever their
    names.
    """
    made = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    df = df.drop(*made)
    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    stride = stride_of(templates)
    base_words, all_words, some_words, found, *more_names = free_names(df, "base_words", "all_words", "some_words", "found", *(f"place{k}" for k in range(len(phrases))), *(f"share{k}" for k in range(len(templates))))
    place_names, share_names = more_names[: len(phrases)], more_names[len(phrases) :]
    ranks = token_order(df, templates, text_col)
    place = {t: k for k, t in enumerate(ranks)}
    held = []
    for label, text in templates:
        tokens = sorted(set(text.split()), key=place.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        held.append((label, tokens, need, tokens[: len(tokens) - need + 1]))
    prefixes = sorted({t for *_, prefix in held for t in prefix})

    text = F.coalesce(F.col(text_col), F.lit(""))
    phrase = "|".join(_GAP.join(p.split()) for p in phrases)
    x = df.select(
        *rest,
        F.regexp_count(text, F.lit(f"{_WORD}+")).cast("long").alias("n_words"),
        F.when(text.rlike(f"(?i)(?<!{_WORD})(?:{phrase})(?!{_WORD})"), words_of(F.translate(text, _UPPER, _LOWER))).otherwise(F.array().cast("array<string>")).alias(base_words),
        words_of(F.lower(text)).alias(all_words),
    )
    x = x.withColumn(some_words, F.when(F.exists(all_words, lambda w: w.isin(prefixes)), F.col(all_words)).otherwise(F.array().cast("array<string>"))).drop(all_words)
    spots = F.filter(F.transform(some_words, lambda w, i: F.when(w.isin(prefixes), i)), lambda i: i.isNotNull())
    # A window that holds a place starts in its stride or in one of the two before.
    blocks = F.array_distinct(F.flatten(F.transform(spots, lambda i: F.transform(F.array(*map(F.lit, range(3))), lambda k: F.greatest((F.floor(i / stride) - k).cast("int"), F.lit(0))))))
    stretch = lambda b: F.slice(some_words, b * stride + 1, F.lit(3 * stride))
    ordered = lambda b: F.struct(b.alias("b"), F.array_intersect(_strings(ranks), stretch(b)).alias("tokens"))
    x = x.select(*rest, "n_words", some_words, *[_places(F.col(base_words), p).alias(name) for name, p in zip(place_names, phrases, strict=True)], F.transform(blocks, ordered).alias(found))

    def may_hold(tokens: list[str], need: int, prefix: list[str]):
        def passes(block: Column) -> Column:
            t = block["tokens"]
            shared = F.try_element_at(F.array_intersect(_strings(prefix), t), F.lit(1))
            room = F.least(len(tokens) - F.array_position(_strings(tokens), shared), F.size(t) - F.array_position(t, shared)) + 1
            return (F.size(t) >= need) & shared.isNotNull() & (room >= need) & (F.size(F.array_intersect(_strings(tokens), t)) >= need)

        return passes

    def most_within(tokens: list[str]):
        """The most tokens that a window which starts in the block's first stride holds."""

        def most(block: Column) -> Column:
            first = block["b"] * stride
            starts = F.filter(F.sequence(first, F.least(first + stride, F.size(some_words)) - 1), lambda i: F.array_contains(_strings(tokens), F.col(some_words)[i]))
            return F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(_strings(tokens), F.slice(some_words, i + 1, F.lit(2 * stride))))))

        return most

    shares = []
    for label, tokens, need, prefix in held:
        most = F.coalesce(F.array_max(F.transform(F.filter(found, may_hold(tokens, need, prefix)), most_within(tokens))), F.lit(0))
        shares.append((label, F.when(most >= need, most / float(len(tokens))).otherwise(0.0)))
    x = x.withColumns({name: share for name, (_, share) in zip(share_names, shares, strict=True)})

    places = [F.col(name) for name in place_names]
    joined = lambda cols: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*cols), lambda c: c.isNotNull()))), ",")
    base = [F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, phrases.values(), strict=True)]
    more = [F.when(F.col(name) > 0, F.lit(label)) for name, (label, _) in zip(share_names, shares, strict=True)]
    n_base = sum((F.size(p).cast("long") for p in places[1:]), F.size(places[0]).cast("long"))
    return x.select(
        *rest,
        "n_words",
        n_base.alias("n_base"),
        F.array_min(F.flatten(F.array(*places))).cast("long").alias("first_word"),
        F.array_max(F.flatten(F.array(*places))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(base + more).alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), *map(F.col, share_names))).alias("score"),
    )
