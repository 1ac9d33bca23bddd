from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from quarryline.llm import exact_dedup
from tests.llm.helpers import LONG, documents


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(doc_id)
    found = []
    for digest, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        for place, doc_id in enumerate(known + [None] * (len(ids) - len(known))):
            found.append((doc_id, keep, len(ids), place == 0, digest))
    return Counter(found)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (1, None), (2, ""), (4, " "), (7, "\x0b"), (3, "a\tb"), (None, "a b"), (None, "only"),
        (11, LONG), (10, LONG.replace(" ", "\n")), (12, "a b")]


@pytest.mark.parametrize("support", [0.0005, 0.2, 0.9])
def test_matches_brute_force(spark, support):
    rows = ROWS + [(100 + i, "hot") for i in range(300)] + [(500 + i, f"cold {i % 150}") for i in range(300)]
    found = exact_dedup.exact_dedup(documents(spark, rows).repartition(7), support)
    assert Counter(map(tuple, found.collect())) == brute(rows)


def test_hot_groups_are_verified(spark):
    rows = [(i, "hot" if i % 3 else f"cold {i}") for i in range(600)]
    digests = documents(spark, rows).select("doc_id", exact_dedup.text_digest("text").alias("text_sha256")).selectExpr("*", "doc_id AS row_no")
    hot = exact_dedup.hot_groups(digests, 0.1).collect()
    assert [(row.keeper.doc_id, row.hot_size) for row in hot] == [(1, 400)]


def test_empty_table(spark):
    empty = documents(spark, [])
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.drop_exact_copies(empty).count() == 0


def test_kept_rows_have_all_columns(spark):
    docs = documents(spark, ROWS, "q_id q_rows own_id whole keeper hot_size row_no q_text_digest")
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((row.doc_id is None, row.doc_id or 0) for row in kept.collect()) == [(False, i) for i in (1, 3, 4, 10, 12)] + [(True, 0)]
