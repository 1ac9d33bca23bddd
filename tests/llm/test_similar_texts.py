from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from quarryline.llm import near_dedup, sieve, similar_texts
from quarryline.session import table
from tests.llm.helpers import SF, documents


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_kept(rows, similarity=0.8):
    """The smallest id that each text reaches over links of similar texts."""
    sets, kept = {i: shingles(text) for i, text in rows}, set()
    left = set(sets)
    while left:
        group, waiting = set(), {left.pop()}
        while waiting:
            one = waiting.pop()
            group.add(one)
            near = {i for i in left if len(sets[i] & sets[one]) >= similarity * len(sets[i] | sets[one])}
            left -= near
            waiting |= near
        kept.add(min(group))
    return sorted(kept)


def edited(words, every):
    return [f"new{random.random()}" if random.random() < 1 / every else w for w in words]


def kept_ids(df):
    return sorted(row.doc_id for row in df.collect())


def test_matches_brute_force(spark):
    random.seed(4)
    texts = []
    for _ in range(40):
        base = random.choices([f"word{i}" for i in range(300)], k=random.choice([5, 40, 200, 900]))
        texts += [base] + [edited(base, every) for every in (20, 40, 60, 100)]
    base = [f"hot{i}" for i in range(300)]
    texts += [edited(base, random.choice([20, 40, 50, 80])) for _ in range(60)]
    random.shuffle(texts)
    rows = list(enumerate(" ".join(words) for words in texts))
    rows += [(1001, None), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "a b c d"), (1006, "a b c d e f g h i"), (1007, "a b c d e f g h i j")]
    expected = brute_kept(rows)
    assert len(expected) < len(rows) * 0.7
    assert kept_ids(similar_texts.drop_similar(documents(spark, rows))) == expected


def test_ids_and_names_of_columns(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(7, text), (6, text.upper()), (8, "other words are here"), (None, text), (8, "other words are here"), (9, None), (10, "")]
    docs = documents(spark, rows, "node root key u v bands many copies")
    kept = similar_texts.drop_similar(docs)
    assert kept.columns == docs.columns and kept_ids(kept) == [6, 8, 9]
    assert similar_texts.drop_similar(documents(spark, [])).count() == 0


def test_pipeline_stage_drops_lightly_edited_copies(spark):
    docs = table(spark, SF, "documents")
    expected = brute_kept([(d.doc_id, d.text) for d in docs.collect()])
    assert kept_ids(corpus_pipeline.remove_near_copies(spark, docs, SF)) == expected


def test_the_sieve_lets_all_keys_through(spark):
    keys = [near_dedup.signed(random.getrandbits(64)) for _ in range(3000)] + [-1, 0, 1 << 62]
    rows = spark.createDataFrame([(k,) for k in keys], "place long")
    found = sieve.sieve(rows, "place")
    assert sieve.falls_through(sieve.as_words(found), np.array(keys)).all()
    others = [near_dedup.signed(random.getrandbits(64)) for _ in range(3000)]
    some = spark.createDataFrame([(k,) for k in keys + others] + [(None,)], "place long")
    through, rest = sieve.split(some, "place", found)
    expected = sieve.falls_through(sieve.as_words(found), np.array(others)).sum()
    assert through.count() == len(keys) + expected + 1 and rest.count() == len(others) - expected and expected < 100
