"""Reviews, evidence and translations in plain cases."""

from __future__ import annotations

import random
import re

import pytest

from quarryline.operators import evidence, review, translations

DECK = [(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 20)]


def log_of(spark, taps):
    deck = spark.createDataFrame(DECK, "deck long, place long, offer_id long")
    rows = spark.createDataFrame([(d, i, a, o) for i, (d, a, o) in enumerate(taps)], "deck long, seq long, action string, offer_id long")
    log = review.replayed(deck, rows)
    return deck, log, [(r.action, r.place, r.offer_id, r.effect, r.about) for r in sorted(log.collect(), key=lambda r: r.seq)]


def test_a_review(spark):
    taps = [
        (1, "prev", None), (1, "seen", None), (1, "no", None), (1, "next", None), (1, "no", None), (1, "next", None), (1, "next", None), (1, "applied", None), (1, "cur", None),
        (1, "undo", 11), (1, "undo", 11), (1, "applied", 11), (1, "prev", None), (1, "undo", None), (2, "undo", None), (2, "next", None), (3, "seen", None),
    ]
    deck, log, found = log_of(spark, taps)
    assert found == [
        ("prev", 0, 10, "moved", None), ("seen", 0, 10, "recorded", 1), ("no", 0, 10, "ignored", None), ("next", 0, 10, "moved", None), ("no", 1, 11, "recorded", 4),
        ("next", 1, 11, "moved", None), ("next", 2, 12, "moved", None), ("applied", 2, 12, "recorded", 7), ("cur", 2, 12, "none", None), ("undo", 2, 11, "undone", 4),
        ("undo", 2, 11, "nothing", None), ("applied", 2, 11, "recorded", 11), ("prev", 2, 12, "moved", None), ("undo", 1, 11, "undone", 11), ("undo", 0, 20, "nothing", None),
        ("next", 0, 20, "moved", None),
    ]
    kept = sorted(tuple(r) for r in review.decisions(log).collect())
    assert kept == [(1, 10, "seen", 1, None, False), (1, 11, "applied", 11, "applications", True), (1, 11, "no", 4, "feedback", True), (1, 12, "applied", 7, "applications", False)]
    assert sorted((r.offer_id, r.decision) for r in review.after_review(deck, log).collect()) == [(10, "seen"), (11, None), (12, "applied"), (20, None)]


@pytest.mark.parametrize("seed", range(20))
def test_standing_summaries(seed):
    made, machine = random.Random(seed), review.Standing()
    rows = [(i, made.choice(["seen", "no", "undo", "applied"])) for i in range(made.randrange(1, 9))]
    for state in (None, -5):
        end = state
        for row in rows:
            end, _ = machine.step(end, row)
        assert machine.after(machine.summary(rows), state) == end


def test_last_application_wins(spark):
    sent = spark.createDataFrame([(1, "Old", "A", 1), (1, "New", "B", 5), (2, "Other", "C", 2)], "id long, title string, company string, seq long")
    said = spark.createDataFrame([(1, 1, "interview", "Monday"), (2, 9, "rejected", None)], "seq long, id long, state string, reason string")
    assert sorted(tuple(r) for r in review.state_records(said, sent).collect()) == [(1, 1, "interview", "Monday", "New", "B", True), (2, 9, "rejected", "", None, None, False)]


def test_evidence_matches_comparing_all(spark):
    terms = ["GIS", "hydrograph", "C++", "tide table", "amarrament", "naïve", "++", "a", "sea-ice", "x1", None, " ", "abcdef", "a.b"]
    texts = [
        "Gist of gis.", "hydrographic survey", "We use c++ and C+++", "tide  table", "tide table", "Tide tables", "moorings", "NAIVE approach", "+ +", "sea-ice sea ice", "x12 x1",
        "xabcdefx", "axb a.b", "ab-cdef", None, "", "deshydrogr", "A",
    ]

    def fold(text):
        import unicodedata

        return "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c)).lower()

    def backs(term, text):
        t, x = fold(term).strip(), fold(text)
        stem = re.sub("[^a-z]", "", t)
        return bool(t) and (bool(re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", x)) or (len(stem) >= 6 and stem[:6] in x))

    frame = spark.createDataFrame(list(enumerate(texts)), "i long, x string")
    found = evidence.evidence(frame, "i", "x", spark.createDataFrame([(t,) for t in terms], "t string"), "t")
    assert sorted((r.text_id, r.term) for r in found.collect()) == sorted((i, t) for i, x in enumerate(texts) for t in terms if t and backs(t, x))


def test_evidence_of_few_terms_shuffles_neither_words_nor_texts(spark, monkeypatch):
    terms = spark.createDataFrame([("tide table",), ("gis",), ("Hydrographe",), ("a b",), ("é tide",)], "t string")
    texts = ["the tide table", "xtide table tide table", "tide tablex", "xtide table", "GIS a b", "deshydrogr", "É tide", "bé tide", None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, x string").repartition(3)
    found = evidence.evidence(frame, "i", "x", terms, "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1
    wanted = [(0, "tide table"), (1, "tide table"), (4, "a b"), (4, "gis"), (5, "Hydrographe"), (6, "é tide")]
    assert sorted(tuple(r) for r in found.collect()) == wanted
    monkeypatch.setattr(evidence, "BROADCAST_TERMS", 2)
    assert sorted(tuple(r) for r in evidence.evidence(frame, "i", "x", terms, "t").collect()) == wanted


def test_translations(spark):
    titles = spark.createDataFrame([("Charpentier naval", "Brest, France"), ("Diver", "Oslo"), ("Taucher", None), ("Held", "x"), ("Diver", "Oslo")], "title string, place string")
    held = spark.createDataFrame([("Held", "x", "Kept", 1), ("Old", "y", "Older", 0)], "title string, place string, translation string, added long")
    asked = translations.lookups(titles, held)
    assert sorted((r.title, r.place) for r in asked.collect()) == [("Charpentier naval", "Brest, France"), ("Diver", "Oslo"), ("Taucher", "")]
    first = spark.createDataFrame([("Charpentier naval", "Brest, France", "charpentier NAVAL"), ("Diver", "Oslo", ""), ("Taucher", "", "Diver ")], "title string, place string, answer string")
    again = translations.second_lookups(asked, first)
    assert [tuple(r) for r in again.collect()] == [("Charpentier naval", "Brest, France", "fr")]
    second = spark.createDataFrame([("Charpentier naval", "Brest, France", "Shipwright")], "title string, place string, answer string")
    table = translations.merged(held, translations.answered(first, second), 7, most=3)
    assert sorted(tuple(r) for r in table.collect()) == [("Charpentier naval", "Brest, France", "Shipwright", 7), ("Held", "x", "Kept", 1), ("Taucher", "", "Diver", 7)]
    assert sorted((r.title, r.translation) for r in translations.shown(titles, table).collect()) == [
        ("Charpentier naval", "Shipwright"), ("Diver", "Diver"), ("Diver", "Diver"), ("Held", "Kept"), ("Taucher", "Diver"),
    ]
