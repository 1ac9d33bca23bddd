"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a line, or a paragraph (lines with words, one under the other), cut into
overlapping stretches where it is longer than ``BLOCK_WORDS``. It matches a template if it
contains at least ``THRESHOLD`` of the template's different words. Every such block is found:

* the words of all templates are counted over all texts, in each task first, and ordered from
  the rarest on; that order is the same for blocks and templates;
* prefix filter: a template of n words that needs k of them meets a block only if one of its
  first n - k + 1 words is among the block's first m - k + 1 (m of its words are template words);
* length filter: m is k at least;
* positional filter: a shared word, its places in both and what is shared before it bound the
  overlap from above;
* what is left is verified by counting the overlap.

Templates are few and go to the tasks; texts stay where they are and are never shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.arrow import column_of, map_batches, texts_of
from quarryline.session import ship_package

THRESHOLD = 0.85
#: Longer blocks are cut into stretches of so many words, a new one every half of it. Templates are half of it at most.
BLOCK_WORDS = 240
#: Phrases whose places are always told, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Sentences by which public licenses are known, and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "Licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "Licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: ASCII digits, letters in lower case and everything beyond ASCII stay, line ends stay, all else is a space.
LETTERS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 or c == 0x0A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
SCAN_SQL = (
    "doc_id long, n_words long, base array<struct<label:string,word:long>>,"
    " matches array<struct<template:long,label:string,word:long,n_words:long,overlap:long,containment:double,best:boolean>>"
)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LETTERS).split()


def needed(size: int, threshold: float) -> int:
    """The least overlap that is ``threshold`` of ``size`` words or more."""
    return max(1, math.ceil(threshold * size - 1e-9))


class TemplateIndex:
    """Templates by the rarest of their words, for the join with blocks."""

    def __init__(self, templates: Sequence[tuple[str, str]], threshold: float, counts: dict[bytes, int]):
        sets = [set(words_of(text)) for _, text in templates]
        order = sorted(set().union(*sets), key=lambda word: (counts.get(word, 0), word))
        self.place = {word: i for i, word in enumerate(order)}
        self.labels = [label for label, _ in templates]
        self.sorted = [sorted(self.place[word] for word in words) for words in sets]
        self.sets = [set(places) for places in self.sorted]
        self.needs = [needed(len(places), threshold) for places in self.sorted]
        self.prefixes: dict[int, list[tuple[int, int]]] = {}
        for number, places in enumerate(self.sorted):
            for at, place in enumerate(places[: len(places) - self.needs[number] + 1]):
                self.prefixes.setdefault(place, []).append((number, at))
        self.openers = frozenset(order[place] for place in self.prefixes)

    def join(self, words: Sequence[bytes]) -> list[tuple[int, set[int]]]:
        """(template, shared words) of all templates that a block of these words contains enough of."""
        block = sorted({self.place[word] for word in words if word in self.place})
        shared: dict[int, int] = {}
        for at, place in enumerate(block):
            for number, other in self.prefixes.get(place, ()):
                need, before = self.needs[number], shared.get(number, 0)
                if before < 0 or at > len(block) - need:
                    continue
                most = before + min(len(block) - at, len(self.sorted[number]) - other)
                shared[number] = before + 1 if most >= need else -1
        found = [(number, self.sets[number].intersection(block)) for number, n in sorted(shared.items()) if n > 0]
        return [(number, common) for number, common in found if len(common) >= self.needs[number]]


def blocks_of(lines: list[list[bytes]]):
    """(first word, end) of all lines and paragraphs with words, long ones cut; what is in two of them comes once."""
    spans, at, opened, deep = [], 0, 0, 0
    for words in [*lines, []]:
        if words:
            spans.append((at, at + len(words)))
            opened, deep = (opened, deep + 1) if deep else (at, 1)
        else:
            if deep > 1:
                spans.append((opened, at))
            deep = 0
        at += len(words)
    for first, end in spans:
        step = BLOCK_WORDS // 2
        for start in range(first, max(first + 1, end - step), step) if end - first > BLOCK_WORDS else (first,):
            yield start, min(end, start + BLOCK_WORDS)


def phrase_places(words: list[bytes], phrases: Sequence[tuple[str, str]]) -> list[tuple[int, str]]:
    """(word, label) of every place where the words of a phrase stand one after another."""
    found, line = [], b" " + b" ".join(words) + b" "
    for phrase, label in phrases:
        sought = b" " + phrase.encode() + b" "
        at, word, seen = line.find(sought), 0, 0
        while at >= 0:
            word += line.count(b" ", seen, at)
            seen = at
            found.append((word, label))
            at = line.find(sought, at + 1)
    return sorted(found)


def word_counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each of these few words stands in all texts: summed in each task, then over tasks."""

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in texts_of(batch):
                counts.update(filter(vocabulary.__contains__, text.translate(LETTERS).split()))
        names = sorted(counts)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in names], pa.string()), pa.array([counts[w] for w in names], pa.int64())], names=["word", "n"])

    ship_package(docs.sparkSession)
    summed = docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {row.word.encode(): row.n for row in summed.collect()}


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, base, matches.

    ``base`` has every place (word, from 0) where a phrase's words stand consecutively in the whole
    text, ``matches`` every block that contains at least ``threshold`` of the different words of a
    template (of ``templates``, label and text): where it starts, its words, overlap and containment;
    ``best`` is false where what it shares with the block is part of what another template shares
    that has greater containment, or the same and more words. Words are
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased. A null, empty or wordless text
    has no words, places or matches; texts of any length are read whole; repeated rows have a row
    each; a null doc_id stays null; an empty table gives no rows; no column but doc_id and text is
    read. Templates have half a block (``BLOCK_WORDS``) at most, so that passages as long as one lie
    in a stretch of a longer block.
    """
    for _, text in templates:
        if not 0 < len(words_of(text)) <= BLOCK_WORDS // 2:
            raise ValueError(f"a template has 1 to {BLOCK_WORDS // 2} words: {text[:40]}")
    vocabulary = frozenset(word for _, text in templates for word in words_of(text))
    counts = word_counts(docs, vocabulary)
    heads = frozenset(phrase.split(" ")[0].encode() for phrase, _ in phrases)
    place = pa.struct([("label", pa.string()), ("word", pa.int64())])
    match = pa.struct([("template", pa.int64()), ("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("overlap", pa.int64()), ("containment", pa.float64()), ("best", pa.bool_())])

    def make():
        index = TemplateIndex(templates, threshold, counts)

        def matches_of(text: bytes) -> list[dict]:
            lines = [line.split() for line in text.split(b"\n")]
            words = [word for line in lines for word in line]
            found = []
            for first, end in blocks_of(lines):
                block = words[first:end]
                if index.openers.isdisjoint(block):
                    continue
                met = [(number, shared, (len(shared) / len(index.sets[number]), len(shared))) for number, shared in index.join(block)]
                found += [
                    {"template": number, "label": index.labels[number], "word": first, "n_words": end - first, "overlap": rank[1], "containment": rank[0],
                     "best": not any(shared <= others and rank < other for _, others, other in met)}
                    for number, shared, rank in met
                ]
            return found

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, base, matches = [], [], []
            for raw in texts_of(batch):
                text = raw.translate(LETTERS)
                words = text.split()
                sizes.append(len(words))
                base.append([] if heads.isdisjoint(words) else [{"label": label, "word": word} for word, label in phrase_places(words, phrases)])
                matches.append([] if index.openers.isdisjoint(words) else matches_of(text))
            return pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(base, pa.list_(place)), pa.array(matches, pa.list_(match))],
                names=["doc_id", "n_words", "base", "matches"],
            )

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, SCAN_SQL)


def license_labels(found: DataFrame) -> DataFrame:
    """Of each row of :func:`scan_licenses`: sizes, first and last place, labels of both kinds, and a score.

    The score is 1 where a phrase stands, else the greatest containment of a template, else 0.
    """
    best = "transform(filter(matches, m -> m.best), m -> m.label)"
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(base.word)").alias("first_word"),
        F.expr("array_max(base.word)").alias("last_word"),
        F.expr("array_join(sort_array(array_distinct(base.label)), ',')").alias("base_labels"),
        F.expr(f"array_join(sort_array(array_union(base.label, {best})), ',')").alias("labels"),
        F.expr("CASE WHEN size(base) > 0 THEN 1.0D ELSE coalesce(array_max(matches.containment), 0.0D) END").alias("score"),
    )


def license_sql(templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the same rows: every block is compared with every template."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    kinds = ", ".join(
        "({}, '{}', {}, {})".format(i, label, sorted({w.decode() for w in words_of(text)}), needed(len(set(words_of(text))), threshold)) for i, (label, text) in enumerate(templates)
    )
    said = ", ".join(f"('{label}', {phrase.split(' ')})" for phrase, label in phrases)
    half = BLOCK_WORDS // 2
    return f"""
WITH lowered AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
whole AS (SELECT doc_id, row_no, regexp_extract_all(t, '{word}') AS w FROM lowered),
phrase(label, p) AS (VALUES {said}),
place AS (
  SELECT row_no, label, i FROM (
    SELECT row_no, label, p, w, unnest(list_filter(range(len(w)), lambda k: w[k + 1] = p[1])) AS i FROM whole, phrase)
  WHERE w[i + 1 : i + len(p)] = p),
line AS (
  SELECT row_no, n, regexp_extract_all(l, '{word}') AS w
  FROM (SELECT row_no, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM lowered)),
kept AS (SELECT *, n - row_number() OVER (PARTITION BY row_no ORDER BY n) AS island FROM line WHERE len(w) > 0),
block AS (
  SELECT row_no, w FROM kept
  UNION ALL
  SELECT row_no, flatten(list(w ORDER BY n)) FROM kept GROUP BY row_no, island HAVING count(*) > 1),
part AS (
  SELECT row_no, row_number() OVER () AS block_no, w[s + 1 : s + {BLOCK_WORDS}] AS w FROM (
    SELECT row_no, w, unnest(CASE WHEN len(w) > {BLOCK_WORDS} THEN range(0, len(w) - {half}, {half}) ELSE [0] END) AS s FROM block)),
template(t, label, words, need) AS (VALUES {kinds}),
met AS (
  SELECT row_no, block_no, label, list_intersect(list_distinct(w), words) AS shared, len(shared) AS n, len(shared) / len(words) AS share
  FROM part, template WHERE len(list_intersect(list_distinct(w), words)) >= need),
told AS (
  SELECT row_no, label FROM place
  UNION
  SELECT row_no, label FROM met WHERE NOT EXISTS (
    FROM met AS o WHERE o.block_no = met.block_no AND list_has_all(o.shared, met.shared) AND (o.share, o.n) > (met.share, met.n))),
a AS (SELECT row_no, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
             array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM place GROUP BY row_no),
b AS (SELECT row_no, array_to_string(list_sort(list(label)), ',') AS labels FROM told GROUP BY row_no),
c AS (SELECT row_no, max(share) AS share FROM met GROUP BY row_no)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM whole LEFT JOIN a USING (row_no) LEFT JOIN b USING (row_no) LEFT JOIN c USING (row_no)
"""
