"""Runs against a definition read word by word."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from quarryline.llm import periodic_runs, queries
from quarryline.session import table
from tests.llm.helpers import SF, by_id, documents


def brute(words, min_words=6, min_exponent=4):
    """All runs by trying every period."""
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(min_words, min_exponent * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    words = planted(doc_id, (text or "").encode().split())
    runs = sorted(brute(words), key=lambda r: (r[0], r[2]))
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def made_texts(seed):
    made = random.Random(seed)
    texts = []
    for _ in range(60):
        n, letters = made.randrange(0, 90), "abcdef"[: made.randrange(1, 6)]
        words = [made.choice(letters) for _ in range(n)]
        for _ in range(made.randrange(3)):  # powers of a root, and copies of stretches with runs in them
            root = [made.choice(letters) for _ in range(made.randrange(1, 7))]
            at = made.randrange(len(words) + 1)
            words[at:at] = (root * 9)[: made.randrange(4 * len(root), 8 * len(root))]
        if words and made.random() < 0.5:
            at = made.randrange(len(words))
            words += [made.choice("xyz"), *words[at : at + 60]]
        texts.append([w.encode() for w in words])
    return texts


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize(("min_words", "min_exponent"), [(6, 4), (2, 2), (4, 3)])
def test_batches_match_brute_force(seed, min_words, min_exponent, monkeypatch):
    monkeypatch.setattr(periodic_runs, "JUMPS", seed % 3)
    texts = made_texts(seed)
    assert periodic_runs.batch_runs(texts, min_words, min_exponent) == [brute(words, min_words, min_exponent) for words in texts]


@pytest.mark.parametrize("word", ["abaab", "a", "ab"])
def test_fibonacci_words_and_powers(word):
    one, other = "a", "ab"
    for _ in range(10):
        one, other = other, other + one
    for text in (other, word * 100, "x" + word * 70 + "y" + word * 70):
        words = [c.encode() for c in text]
        assert periodic_runs.batch_runs([words], 2, 2) == [brute(words, 2, 2)]


def test_long_texts_stay_linear():
    for words in ([b"a"] * 400_000, [b"a", b"b", b"c"] * 150_000, [str(i % 1009).encode() for i in range(300_000)]):
        period = len(set(words))
        assert periodic_runs.batch_runs([words]) == [[(0, len(words), period)]]


def test_query_matches_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = [(d.doc_id, d.text) for d in table(spark, sf, "documents").collect()]
        found = queries.op11_periodic_runs(spark, sf)
        assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
        rows = sorted(tuple(r) for r in found.collect())
        assert rows == sorted(digest(i, t) for i, t in docs) and sum(r[1] > 0 for r in rows) > len(rows) // 20


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y " * 9), (7, "naïve über " * 8), (8, "a a " * 3)]
    docs = documents(spark, rows, "runs collapsed a.b w`x start")
    found = periodic_runs.find_runs(docs)
    assert sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in found.collect()) == sorted([
        ("1", [], ""), ("2", [], ""), ("3", [], ""), ("4", [(0, 6, 1)], "a"), ("4", [(0, 6, 1)], "a"), ("None", [(0, 18, 2)], "x y"),
        ("7", [(0, 16, 2)], "naïve über"), ("8", [], "a a a a a a"),
    ])
    digests = by_id(periodic_runs.run_digests(periodic_runs.find_runs(periodic_runs.planted_tails(docs))))
    for doc_id, text in rows:
        if doc_id is not None:
            assert tuple(digests[doc_id]) == digest(doc_id, text)
    assert digests[None].n_runs == 1
    assert periodic_runs.find_runs(documents(spark, [])).count() == 0
