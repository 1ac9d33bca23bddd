"""Quality and toxicity: held-out scores, held-out rows teach nothing, awkward rows."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from quarryline.llm import quality, toxicity
from quarryline.session import table
from tests.llm.helpers import LONG, by_id, documents

LABELS = "doc_id long, quality int, toxic int"


def auc(pairs):
    good, bad = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("name", "label", "modulus", "rest", "least"), [("op6_quality", "quality", 4, 2, 0.98), ("op10_toxicity", "toxic", 3, 1, 0.93)])
def test_held_out_rows(spark, name, label, modulus, rest, least):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.1"
    found = queries()[name](spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in found.collect()}
    assert len(rows) == 10_000
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % modulus == rest) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.7)
    known = {r.doc_id: r[label] for r in table(spark, sf, "labels").collect()}
    judged = [(known[i], r.score, r.predicted) for i, r in rows.items() if r.held_out and i in known]
    assert len(judged) > 500 and auc([(y, s) for y, s, _ in judged]) > least
    assert sum(y == p for y, _, p in judged) / len(judged) > 0.97
    clean = [p for y, _, p in judged if not y]
    assert sum(clean) / len(clean) < 0.02


def labelled(spark):
    random.seed(2)
    plain = "table window garden paper morning letter season market".split()
    rows, labels = [], []
    for i in range(400):
        words = random.choices(plain, k=40)
        if i % 4 == 0:
            for _ in range(4):
                words[random.randrange(40)] = random.choice(["dreckling", "drecklings", "gnarlfool"])
        rows.append((i, " ".join(words if i % 2 else [w.title() + random.choice("!#%") for w in words])))
        labels.append((i, i % 2, int(i % 4 == 0)))
    return rows, spark.createDataFrame(labels, LABELS)


AWKWARD = [(900, None), (901, ""), (902, "  \n"), (903, LONG), (904, "garden"), (904, "garden"), (None, "garden")]


def test_quality_of_awkward_rows(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, rows + AWKWARD, "quality score unit d0 features")
    found = quality.quality(docs, labels)
    scores = by_id(found)
    assert found.count() == len(rows) + len(AWKWARD)
    assert scores[900].score == scores[901].score == scores[902].score and scores[904].score == scores[None].score
    assert all(np.isfinite(r.score) for r in scores.values())
    assert min(scores[i].score for i in range(1, 400, 2)) > 0.7 > 0.3 > max(scores[i].score for i in range(0, 400, 2))


def test_toxicity_folds_and_excuses(spark):
    rows, labels = labelled(spark)
    more = [(910, "garden paper dr3ckl1ng market"), (911, "garden paper DRЕCKLING market"), (912, "garden paper market")]
    found = by_id(toxicity.toxicity(documents(spark, rows + AWKWARD + more, "toxic stem before word place"), labels))
    assert found[910].score == found[911].score > found[912].score == found[901].score
    assert found[900].score == found[901].score and found[904].score == found[None].score and found[903].predicted == 0
    assert all(found[i].predicted == (i % 4 == 0) for i in range(400))


def test_exceptions_hide_their_match():
    lexicon = toxicity.Lexicon({"drec": 3.0}, ["kein dreckling"], (1.0, 1.0, -2.0))
    assert lexicon.features("kein dreckling hier") == (0.0, 0.0)
    assert lexicon.features("ein dreckling hier")[0] == np.log1p(3.0)
    assert lexicon.features("undreckling")[0] == 0, "only word beginnings match"
    short, long = lexicon.features("ein dreckling"), lexicon.features("ein dreckling" + " wort" * 500)
    assert short[0] == long[0] and short[1] > long[1]


@pytest.mark.parametrize(("run", "modulus", "rest"), [(quality.quality, 4, 2), (toxicity.toxicity, 3, 1)])
def test_held_out_labels_teach_nothing(spark, run, modulus, rest):
    rows, labels = labelled(spark)
    docs = documents(spark, rows)
    turned = [(r.doc_id, 1 - r.quality, 1 - r.toxic) if zlib.crc32(str(r.doc_id).encode()) % modulus == rest else tuple(r) for r in labels.collect()]
    one, other = by_id(run(docs, labels)), by_id(run(docs, spark.createDataFrame(turned, LABELS)))
    assert {i: r.score for i, r in one.items()} == {i: r.score for i, r in other.items()}


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_empty_tables(spark, run):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (77, 1, 1)], LABELS)
    assert run(documents(spark, []), none).count() == 0
    for labels in (none, odd):
        assert all(0 <= r.score <= 1 for r in run(documents(spark, [(1, "some text"), (2, None)]), labels).collect())


def naive_units(text, vocabulary):
    words, units = (text or "").split(), []
    for i, word in enumerate(words):
        bare = quality.plain_word(word)
        shared = quality.shape_unit(word) if bare is None else zlib.crc32(bare.encode()) % quality.PLAIN
        if i and words[i - 1] == word:
            units.append(quality.REPEATS + shared)
        else:
            units.append(quality.SHARED + vocabulary[bare] if bare in vocabulary else shared)
    return units


def naive_vectors(texts, vocabulary):
    total = np.zeros((quality.UNITS, quality.DIMENSIONS))
    for text in texts:
        units = naive_units(text, vocabulary)
        for i, unit in enumerate(units):
            for j in range(max(0, i - quality.REACH), min(len(units), i + quality.REACH + 1)):
                if i != j:
                    total[unit] += quality.INDEX[units[j]]
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)


def test_word_vectors_match_brute_force(spark, monkeypatch):
    texts = ["one two three two two", "four one, Two", None, "", "4 x% x%"] * 3
    docs = documents(spark, list(enumerate(texts))).repartition(3)
    assert quality.vocabulary_of(docs) == {"four": 0, "one": 1, "three": 2, "two": 3}
    assert quality.vocabulary_of(docs, 2) == {"one": 0, "two": 1}
    for size in (2, 8):
        vocabulary = quality.vocabulary_of(docs, size)
        assert np.allclose(quality.corpus_vectors(docs, vocabulary), naive_vectors(texts, vocabulary))


def test_quality_matches_brute_force(spark):
    rows, labels = labelled(spark)
    rows += AWKWARD[:3] + [(905, "Garden garden garden  paper! a 7 §§")]
    docs = documents(spark, rows)
    counts = Counter(b for _, text in rows for w in (text or "").split() if (b := quality.plain_word(w)))
    vocabulary = {w: i for i, w in enumerate(sorted(sorted(counts, key=lambda w: (-counts[w], w))[: quality.VOCABULARY]))}
    table = np.hstack((naive_vectors([text for _, text in rows], vocabulary), quality.INDEX / np.sqrt(quality.NONZERO)))

    def features(text):
        units = naive_units(text, vocabulary)
        mean = sum((table[u] for u in units), np.zeros(table.shape[1])) / max(1, len(units))
        return np.append(mean, np.log1p(len(units)) / 10)

    texts = dict(rows)
    taught = sorted((r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    aside = np.array([zlib.crc32(f"c{i}".encode()) % quality.CALIBRATE_OF == 0 for i, _ in taught])
    x, y = np.array([features(texts[i]) for i, _ in taught]), np.array([q for _, q in taught], float)
    network = quality.Network(x.shape[1])
    network.fit(x[~aside], y[~aside])
    network.calibrate(x[aside], y[aside])
    found = quality.quality(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.score == pytest.approx(float(network.probability(features(texts[r.doc_id])[None])[0]), abs=1e-6)


def naive_hits(folded, key):
    """Every (start, end) at which ``key`` stands in a text."""
    found, at = [], folded.find(key)
    while at >= 0:
        found.append((at, at + len(key) - 1))
        at = folded.find(key, at + 1)
    return found


def brute_toxicity(sample, texts):
    """Lexicon, exceptions and scores from the sampled rows, counted one word at a time."""
    words, size = [], {0: 0, 1: 0}
    for row in sample:
        if not row.calibrates:
            size[row.toxic] += 1
            folded = toxicity.fold(row.text).split()
            words += [(row.doc_id, row.toxic, w, b) for w, b in zip(folded, ["", *folded]) if len(w) >= toxicity.SHORTEST]
    needed, ratio = max(toxicity.LEAST_SEEN, toxicity.LEAST_SHARE * size[1]), (size[1] + 1) / (size[0] + 1)
    uses = {}
    for doc_id, toxic, word, before in words:
        for n in {*range(toxicity.SHORTEST, min(len(word), toxicity.LONGEST) + 1), len(word)}:
            uses.setdefault(word[:n], []).append((doc_id, toxic, before))
    odds = {}
    for stem, rows in uses.items():
        sums = [sum(r[1] == c for r in rows) for c in (0, 1)]
        clean, bad = (min(len({r[0] for r in rows if r[1] == c}), len({r[2] for r in rows if r[1] == c})) for c in (0, 1))
        if sums[1] >= needed and sums[1] > 2 * ratio * sums[0] and bad >= needed:
            odds[stem] = np.log((bad + 0.5) / (clean + 0.5) / ratio)
    weights = {}
    for stem in sorted((s for s in odds if odds[s] >= toxicity.LEAST_ODDS), key=lambda s: (len(s), s)):
        if odds[stem] >= max([w for s, w in weights.items() if stem.startswith(s) and s != stem and len(s) <= toxicity.LONGEST], default=0) + toxicity.BETTER:
            weights[stem] = odds[stem]
    phrases = {}
    for doc_id, toxic, word, before in words:
        if before and any(word.startswith(s) for s in weights):
            phrases.setdefault(f"{before} {word}", []).append((doc_id, toxic))
    phrases = [p for p, rows in phrases.items() if not any(t for _, t in rows) and len({d for d, _ in rows}) >= 2]

    def features(text):
        folded = toxicity.fold(text)
        excused = [x for p in phrases for x in naive_hits(folded, f" {p} ")]
        total = sum(w for s, w in weights.items() for a, b in naive_hits(folded, f" {s}") if not any(c <= a and b <= d for c, d in excused))
        return np.log1p(total), np.log1p(100 * total / max(1, folded.count(" ") - 1))

    rows = [r for r in sample if r.calibrates]
    return weights, phrases, features, np.array([features(r.text) for r in rows]), np.array([r.toxic for r in rows], float)


def test_toxicity_matches_brute_force(spark):
    rows, labels = labelled(spark)
    rows = [(i, text.replace("drecklings", "kein dreckling") if i % 3 else text) for i, text in rows]
    rows += [(i, "paper garden ganz gnarlfool market") for i in range(1001, 1012)]
    labels = labels.union(spark.createDataFrame([(i, 1, 0) for i in range(1001, 1012)], LABELS))
    docs = documents(spark, rows + AWKWARD)
    sample = toxicity.training_sample(docs, labels).collect()
    weights, phrases, features, xs, ys = brute_toxicity(sample, rows)
    lexicon = toxicity.train(docs, labels)
    assert lexicon.weights == pytest.approx(weights) and weights
    assert sorted(lexicon.exceptions) == sorted(phrases) and phrases
    usable = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    a, b, c = toxicity.fit_line(xs, ys, (sum(r.toxic for r in usable) + 1) / (len(usable) + 2))
    found = toxicity.toxicity(docs, labels).collect()
    texts = {i: t for i, t in rows + AWKWARD}
    assert len(found) == len(rows) + len(AWKWARD)
    for r in found:
        x, y = features(texts[r.doc_id] or "")
        assert r.score == pytest.approx(1 / (1 + np.exp(-(a * x + b * y + c))), abs=1e-6)
        assert r.predicted == int(r.score >= 0.7)


def test_excuses_are_found_in_one_sweep():
    random.seed(9)
    for _ in range(300):
        spans = lambda: [(a, a + random.randrange(12)) for a in random.choices(range(60), k=random.randrange(12))]
        hits, excused = [(a, b, 1.0) for a, b in spans()], spans()
        expected = sorted(h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in excused))
        assert sorted(toxicity.unexcused(hits, excused)) == expected
    lexicon = toxicity.Lexicon({"drec": 3.0}, ["kein dreckling"])
    began = time.process_time()
    lexicon.features("kein dreckling dreck " * 200_000)
    assert time.process_time() - began < 10


def test_letters_in_other_forms_are_folded():
    plain = toxicity.fold("dreckling")
    for form in ("ＤＲＥＣＫＬＩＮＧ", "𝐝𝐫𝐞𝐜𝐤𝐥𝐢𝐧𝐠", "ｄｒéｃｋlïñg", "dr3ckl1ng", "drесkling", "Ⓓreckling"):
        assert toxicity.fold(form) == plain, form


def test_repeated_ids_and_labels(spark):
    rows, labels = labelled(spark)
    again = documents(spark, rows + [(0, f"different text {i}") for i in range(50)] + rows[1:])
    sample = toxicity.training_sample(again, labels.union(labels))
    assert sample.count() == sample.select("doc_id").distinct().count()
    rows_of = quality.labelled_features(again, labels.union(labels), {}, np.zeros((quality.UNITS, 2)))
    assert rows_of.count() == rows_of.select("doc_id").distinct().count()
