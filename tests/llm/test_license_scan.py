"""License scans against a comparison of every block with every template."""

from __future__ import annotations

import random
import re

import pytest

from quarryline.llm import license_scan
from tests.compare import duck, sparks
from tests.llm.helpers import by_id, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, templates, threshold):
    """(words, base places, {(first word, words, template): overlap}) by comparing all."""
    words = WORD.findall(lowered(text))
    base = sorted((i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    blocks, at, group = [], 0, []
    for line in [*lowered(text).split("\n"), ""]:
        found = WORD.findall(line)
        if found:
            blocks.append((at, at + len(found)))
            group.append(at)
        else:
            if len(group) > 1:
                blocks.append((group[0], at))
            group = []
        at += len(found)
    size = license_scan.BLOCK_WORDS
    cut = [(a, b) for a, b in blocks if b - a <= size]
    for a, b in blocks:
        if b - a > size:
            cut += [(s, min(b, s + size)) for s in range(a, b - size // 2, size // 2)]
    met = {}
    for a, b in cut:
        for number, (_, template) in enumerate(templates):
            needs = set(WORD.findall(lowered(template)))
            overlap = len(needs & set(words[a:b]))
            if overlap / len(needs) >= threshold:
                met[a, b - a, number] = overlap
    return len(words), base, met


def made_texts(seed):
    made = random.Random(seed)
    texts = [None, "", "\n\n", "!!!", "cc by cc by CC-BY", "mit licensed", "MIT\nLicense", "the gnu general public\n\nlicense"]
    for _ in range(40):
        lines = []
        for _ in range(made.randrange(1, 12)):
            words = [made.choice("the of software license copy é über river 2 0 under this".split()) for _ in range(made.randrange(0, 14))]
            if made.random() < 0.5:
                label, template = made.choice(license_scan.TEMPLATES)
                said = [w for w in template.split() if made.random() < made.choice([0.8, 0.9, 1.0])]
                words += said
            if made.random() < 0.1:
                words = words * 60
            lines.append(made.choice([" ", "\n"]).join(words))
        texts.append(made.choice(["\n", "\n\n"]).join(lines))
    return texts


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_finds_every_block(spark, threshold):
    texts = made_texts(int(threshold * 100))
    found = by_id(license_scan.scan_licenses(documents(spark, list(enumerate(texts))), threshold=threshold))
    some = 0
    for i, text in enumerate(texts):
        n, base, met = brute(text, license_scan.TEMPLATES, threshold)
        assert found[i].n_words == n and [(b.word, b.label) for b in found[i].base] == base
        assert {(m.word, m.n_words, m.template): m.overlap for m in found[i].matches} == met
        some += len(met)
    assert some > 50


def test_the_counts_only_order_the_words():
    for counts in ({}, {b"license": 10**9}, {b"mit": 5, b"the": 3}):
        index = license_scan.TemplateIndex(license_scan.TEMPLATES, 0.85, counts)
        for label, text in license_scan.TEMPLATES:
            assert label in {index.labels[number] for number, _ in index.join(license_scan.words_of(text))}


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", "mit"),
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU Affero General Public\nLicense as published by the Free Software Foundation", "agpl"),
        ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following conditions are met:", "bsd"),
        ("We went to the river under the bridge.", ""),
    ],
)
def test_labels(spark, text, labels):
    row = license_scan.license_labels(license_scan.scan_licenses(documents(spark, [(1, "Intro.\n\n" + text + "\n\nEnd.")]))).first()
    assert row.labels == labels and (row.score >= 0.85) == bool(labels)


def test_awkward_rows(spark):
    long = "river stone " * 50_000 + "\nReleased under the MIT License. " + "bridge night " * 50_000
    rows = [(1, None), (2, ""), (3, long), (4, "mit license"), (4, "mit license"), (None, "cc by")]
    found = license_scan.license_labels(license_scan.scan_licenses(documents(spark, rows, "words base a.b w`x label")))
    shown = sorted((str(r.doc_id), *tuple(r)[1:]) for r in found.collect())
    assert shown == sorted([
        ("1", 0, 0, None, None, "", "", 0.0), ("2", 0, 0, None, None, "", "", 0.0), ("3", 200_005, 1, 100_003, 100_003, "mit", "mit", 1.0),
        ("4", 2, 1, 0, 0, "mit", "mit", 1.0), ("4", 2, 1, 0, 0, "mit", "mit", 1.0), ("None", 2, 1, 0, 0, "cc-by", "cc-by", 1.0),
    ], key=str)
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan_licenses(documents(spark, []), templates=[("x", "word " * 200)])


def test_made_texts_match_sql(spark, tmp_path):
    docs = documents(spark, list(enumerate(made_texts(7))))
    docs.coalesce(1).write.parquet(str(tmp_path / "made"))
    part = next((tmp_path / "made").glob("part-*.parquet"))
    part.rename(tmp_path / "documents.parquet")
    assert sparks(license_scan.license_labels(license_scan.scan_licenses(docs))) == duck(license_scan.license_sql(), str(tmp_path))
