"""Licence notices by an exact set-similarity join of text blocks with templates.

A block is a line with those after it, as far as ``WRAPPED`` lines have at most
``WIDTH`` characters together, so a notice wrapped over lines is one block; a longer
line is a block by itself. A template is a notice; both are sets of words. A block meets
a template when it holds at least ``threshold`` of the template's words. Texts and blocks
in which none of a template's few longest words occurs anywhere cannot meet it, and are
left out before any words are taken from them. Template words are ordered by how many blocks of the whole corpus hold them, rarest first:

- prefix filter: a block with enough of a template's words holds one of its first
  ``size - need + 1``, so blocks join templates on those few rare words only;
- length filter: it holds at least ``need`` words of the templates' vocabulary;
- positional filter: from the place of the word shared, in the template and in the
  block's own ordered list, no more can follow than either list has left.

What is left is counted exactly, so every block that meets the threshold is found.
Everything is DataFrame functions. Only the vocabulary of the templates, a
parameter, is counted to the driver and broadcast; labels join the documents by a
hash of the text, so repeated ids and repeated rows get what their text deserves.

Null text counts as empty: no words, no labels, score 0.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.base import ascii_lower, table
from rolesift.session import broadcast_if_small, materialize, release

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# base phrases and their labels: fixed values
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# notices as they are commonly written: fixed values
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.85
# lines of a block of several lines, and their characters at most, line ends included
WRAPPED, WIDTH = 8, 640


def lowered(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` is far faster, and can differ in ASCII letters only for two characters."""
    odd = text.contains("İ") | text.contains("K")
    return F.when(odd, ascii_lower(text)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def word_sets(templates) -> list[tuple[str, list[str]]]:
    import re

    return [(label, sorted(set(re.findall(WORD, text.lower())))) for label, text in templates]


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def may_meet(text: Column, sets: list[tuple[str, list[str]]], threshold: float) -> Column:
    """Whether a text can hold enough of any template: one of the ``size - need + 1`` longest words must occur."""
    hints = set()
    for _, words in sets:
        longest = sorted(words, key=lambda w: (-len(w), w))
        hints.update(longest[: len(words) - _needed(len(words), threshold) + 1])
    return reduce(or_, [text.contains(w) for w in sorted(hints)], F.lit(False))


def _from_line(lines: Column, i: Column) -> Column:
    """The block that starts with the ``i``-th line, from 1."""
    upto = lambda k: F.array_join(F.slice(lines, i, k), "\n")
    counts = F.sequence(F.lit(1), F.least(F.lit(WRAPPED), F.size(lines) - i + 1))
    return upto(F.array_max(F.filter(counts, lambda k: (k == 1) | (F.length(upto(k)) <= WIDTH))))


def blocks(documents: DataFrame, sets: list[tuple[str, list[str]]], threshold: float = THRESHOLD) -> DataFrame:
    """Each block that may meet a template: key of its text, and its words of the templates' vocabulary as a set."""
    vocabulary = sorted({w for _, words in sets for w in words})
    low = documents.select(*_key(F.col("text")), lowered(F.col("text")).alias("low"))
    lines = low.filter(may_meet(F.col("low"), sets, threshold)).select("k1", "k2", F.split("low", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"))
    rows = lines.select("k1", "k2", F.explode(F.transform(starts, lambda i: _from_line(F.col("lines"), i))).alias("block"))
    kept = F.array_intersect(words_of(F.col("block")), F.array(*map(F.lit, vocabulary)))
    rows = rows.filter(may_meet(F.col("block"), sets, threshold)).select("k1", "k2", kept.alias("held"))
    return rows.filter(F.size("held") > 0).distinct()


def find_blocks(documents: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(k1, k2, label, score): for each text and label the best containment met by one of its blocks."""
    spark = documents.sparkSession
    sets = word_sets(templates)
    vocabulary = sorted({w for _, words in sets for w in words})
    held = materialize(blocks(documents, sets, threshold))  # read twice; a block's few words of the vocabulary
    # how many blocks hold each word of the vocabulary: one row a word
    counts = dict(held.select(F.explode("held").alias("word")).groupBy("word").count().collect())
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    rows, least = [], len(vocabulary)
    for number, (label, words) in enumerate(sets):
        ordered = sorted(rank[w] for w in words)
        need = _needed(len(ordered), threshold)
        least = min(least, need)
        for place, r in enumerate(ordered[: len(ordered) - need + 1]):
            rows.append((r, number, label, place, len(ordered), need, ordered))
    prefixes = spark.createDataFrame(
        rows, "rank int, template int, label string, place int, size int, need int, ranks array<int>"
    )
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    ordered = held.filter(F.size("held") >= least).select(
        "k1", "k2", F.array_sort(F.transform("held", lambda w: ranks[w])).alias("own")
    )
    seen = ordered.select("k1", "k2", "own", F.posexplode("own").alias("at", "rank"))
    left = 1 + F.least(F.col("size") - F.col("place") - 1, F.size("own") - F.col("at") - 1)
    # at its first shared word the bound holds in full; later ones only find the pair again
    pairs = seen.join(F.broadcast(prefixes), "rank").filter((F.size("own") >= F.col("need")) & (left >= F.col("need")))
    overlap = F.size(F.array_intersect("own", "ranks"))
    met = pairs.filter(overlap >= F.col("need")).select("k1", "k2", "label", (overlap / F.col("size")).alias("score"))
    best = materialize(met.groupBy("k1", "k2", "label").agg(F.max("score").alias("score")))
    release(held)
    return best


def _places(words: Column, text: Column, phrase: str) -> Column:
    """Starts of a phrase, from 0; the words are compared only where the text holds all of them."""
    parts = phrase.split()
    holds = text.contains(parts[0])
    for part in parts[1:]:
        holds = holds & text.contains(part)
    starts = F.filter(
        F.sequence(F.lit(1), F.size(words) - len(parts) + 1),
        lambda i: F.slice(words, i, len(parts)) == F.array(*map(F.lit, parts)),
    )
    none = F.array().cast("array<int>")
    return F.when(holds & (F.size(words) >= len(parts)), F.transform(starts, lambda i: i - 1)).otherwise(none)


def scan(
    documents: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row a document: words, places of base phrases, their labels, all labels, best score."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = find_blocks(texts, templates, threshold).groupBy("k1", "k2").agg(
        F.collect_set("label").alias("more"), F.max("score").alias("best")
    )
    rows = texts.select("doc_id", *_key(F.col("text")), lowered(F.col("text")).alias("low"))
    rows = rows.select("doc_id", "k1", "k2", "low", words_of(F.col("low")).alias("words"))
    starts = {label: _places(F.col("words"), F.col("low"), phrase) for phrase, label in phrases.items()}
    rows = rows.select(
        "doc_id", "k1", "k2", F.size("words").cast("long").alias("n_words"),
        *[s.alias(f"p{i}") for i, s in enumerate(starts.values())],
    )
    every = F.concat(*[F.col(f"p{i}") for i in range(len(starts))])
    base = F.filter(
        F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(starts)]), lambda x: x.isNotNull()
    )
    rows = rows.select(
        "doc_id", "k1", "k2", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
    )
    joined = rows.join(broadcast_if_small(found), ["k1", "k2"], "left")
    more = F.coalesce("more", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", more)), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op10_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """Brute force: every block against every template, every word against every phrase."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(
        f"('{label}', {quoted(ws)}, {_needed(len(ws), THRESHOLD)})" for label, ws in word_sets(TEMPLATES)
    )
    places = " || ".join(
        f"[{{'at': i - 1, 'label': '{label}'}} for i in generate_series(1, len(w) - {len(p.split()) - 1}) "
        f"if w[i:i + {len(p.split()) - 1}] = {quoted(p.split())}]"
        for p, label in PHRASES.items()
    )
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
w AS (SELECT r, doc_id, regexp_extract_all(low, '{word}') AS w FROM d),
p AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, {places} AS p FROM w),
l AS (SELECT r, string_split(low, chr(10)) AS l FROM d),
i AS (SELECT r, l, unnest(generate_series(1, len(l))) AS i FROM l),
k AS (SELECT r, l, i, list_max([k for k in generate_series(i, least(i + {WRAPPED - 1}, len(l)))
        if k = i or len(array_to_string(l[i:k], chr(10))) <= {WIDTH}]) AS k FROM i),
b AS (SELECT r, list_distinct(regexp_extract_all(array_to_string(l[i:k], chr(10)), '{word}')) AS held FROM k),
t(label, ws, need) AS (VALUES {templates}),
m AS (SELECT r, label, len(list_intersect(held, ws)) / len(ws) AS score FROM b JOIN t
      ON len(held) >= need AND len(list_intersect(held, ws)) >= need),
s AS (SELECT r, list(label) AS more, max(score) AS best FROM m GROUP BY r)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base,
  list_min([x.at for x in p])::BIGINT AS first_word, list_max([x.at for x in p])::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct([x.label for x in p])), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct([x.label for x in p] || coalesce(more, []))), ','), '') AS labels,
  greatest(CASE WHEN len(p) > 0 THEN 1.0 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
FROM p LEFT JOIN s USING (r)
"""


QUERIES = {"op10_license_join": (op10_license_join, _sql())}
