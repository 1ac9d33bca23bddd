from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from quarryline.functions import scalars, text
from quarryline.functions.patterns import NEVER, bounded, folded, listed_pattern


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Élan", "elan"), ("e\u0301te", "ete"), ("Straße", "straße"), ("Ångström", "angstrom"), (None, ""), ("", "")],
)
def test_fold(spark, given, expected):
    assert one(spark, text.fold(F.lit(given).cast("string"))) == expected


def test_fold_agrees_with_the_pattern_side(spark):
    for word in ("País", "Österreich", "çà", "naïve"):
        assert one(spark, text.fold(F.lit(word))) == folded(word)


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<p>a<b>b</b></p><p>c</p>", "ab c"),
        ("<li>x.</li><li>y</li>", "x. y."),
        ("5 < 6 <!-- gone - - --> ok", "5 < 6 ok"),
        ("a&nbsp;b&#160;c &amp; d", "a b c & d"),
        ("<strong>de 3 a</strong>ños", "de 3 años"),
        (None, ""),
    ],
)
def test_html_text(spark, html, expected):
    assert one(spark, text.html_text(F.lit(html).cast("string"))) == expected


def test_hostile_markup_is_linear(spark):
    hostile = spark.createDataFrame([("<div " * 40_000,), ("<!-- " * 40_000,), ("<b " * 60_000,)], "html string")
    began = time.time()
    hostile.select(F.length(text.html_text("html"))).collect()
    assert time.time() - began < 20


@pytest.mark.parametrize(
    ("url", "safe"),
    [("https://a.example/x", True), ("ftp://a.example", False), ("https://a b", False), ("https://a|b", False), ("", False), (None, False), ("http://", False), ("https://x\ny", False)],
)
def test_url_is_safe(spark, url, safe):
    assert one(spark, text.url_is_safe(F.lit(url).cast("string"))) is safe


def test_url_key_cuts_one_slash_and_keeps_fragments(spark):
    assert one(spark, text.url_key(F.lit("https://a.example/x//?q=1"))) == "https://a.example/x/"
    assert one(spark, text.url_key(F.lit("https://a.example/x#top"))) == "https://a.example/x#top"


def test_slug_survives_broken_encoding(spark):
    assert one(spark, text.slug_title(F.lit("https://a.example/jobs/tide%20clerk-2807en/"))) == "tide clerk"
    assert one(spark, text.slug_title(F.lit("https://a.example/jobs/50%-off_tide"))) == "50% off tide"


def test_wrapped_lines_and_labels(spark):
    words = F.array(*map(F.lit, ["aa", "bb", "cccccc", "d"]))
    assert one(spark, text.wrapped_lines(words, 5)) == ["aa bb", "cccccc", "d"]
    labels = F.array(F.lit("Deep diver/Diver"), F.lit("diver"), F.lit("one two three four five"))
    assert one(spark, text.usable_labels(labels)) == ["Diver", "Deep diver"]


def test_senders(spark):
    assert one(spark, text.sender_name(F.lit('"Ann Reed" <ann@reed.example>'))) == "Ann Reed"
    for name, shown in (("Careers", ""), ("No-Reply", ""), ("Do not reply", ""), ("Recruiting Team", ""), ("HR at Gull", ""), ("Hrafn", "Hrafn"), ("Jobst", "Jobst"), ("Notifications Inc", "Notifications Inc")):
        assert one(spark, text.sender_name(F.lit(f"{name} <x@y.example>"))) == shown
    assert one(spark, text.sender_domain(F.lit("x@mail.tidalworks.example.com"))) == "tidalworks"
    assert one(spark, text.sender_domain(F.lit("x@mail.platform.com"), ("platform",))) == ""


def test_titles(spark):
    assert one(spark, text.clean_title(F.lit("Diver (m/w/d) -"))) == "Diver"
    for written, shown in (
        ("Diver (w/m/div.) North", "Diver North"), ("Diver H/F", "Diver"), ("H/F Diver f/h |", "H/F Diver"), ("Diver (All Genders)", "Diver"), ("Diver (north)", "Diver (north)"),
        ("Diver (a/b/c/d/e)", "Diver (a/b/c/d/e)"), ("Diver (m)", "Diver (m)"), (None, ""), ("Diver ( m / w )", "Diver"),
    ):
        assert one(spark, text.clean_title(F.lit(written).cast("string"))) == shown
    assert one(spark, text.compact_title(F.lit("Diver (temporary) - Energy sector - North"))) == "Diver - North"
    assert one(spark, text.compact_title(F.lit("word " * 90))).endswith("…")


def test_patterns():
    import re

    assert re.search(bounded("ring"), "a ring b") and not re.search(bounded("ring"), "string")
    assert re.search(bounded("*ring"), "string") and re.search(bounded("ring", plural=True), "rings")
    assert re.search(bounded("C++"), "some c++ here")
    assert listed_pattern(None, "x") == "x" and listed_pattern([], "x") == NEVER
    assert listed_pattern(["a(", "b"], "x") == "(?:b)" and listed_pattern(["a("], "x") == "x"


def test_scalars(spark):
    assert one(spark, scalars.positive_ids(F.array(*map(F.lit, ["#3", "3", "x", "-1", "4"])))) == [3, 4]
    assert one(spark, scalars.ordinal_date(F.lit("2026-07-22").cast("date"))) == "22nd July 2026"
    midnight = scalars.floor_days(F.lit("2024-01-02 01:00:00").cast("timestamp"), F.lit("2024-01-01 23:00:00").cast("timestamp"))
    assert one(spark, midnight) == 0


def test_commands_of_many_lines(spark):
    from quarryline.streaming.twins import command

    for line, name, ids, note in (("No queas.\nÍtarr", "reject_which", [], "queas.\nÍtarr"), ("no 7 far\naway", "reject", [7], "far\naway"), ("longshot 8\nworth\nit", "longshot", [8], "worth\nit"),
                                  ("interview #5 on\nMonday", "interview", [5], "on\nMonday"), ("help\nme\nnow", "help", [], ""), ("nothing\nhere", "unknown", [], "")):
        found = one(spark, command(F.lit(line)))
        assert (found.command, found.ids, found.note) == (name, ids, note)


def test_priorities_end_at_letters_of_any_script(spark):
    from quarryline.operators.rules import names_priority

    for body, named in (("süß undße", False), ("und_so", True), ("quæ que", True), ("øund", False), ("und", True), ("Ünd", True), (None, False), ("write C++17", True)):
        assert one(spark, names_priority(F.lit("x"), F.lit(body).cast("string"), ("und", "QUE", "C++"))) is named


#: Of each literal text: years, why, degree, language, stage.
DEMANDED = {
    1: (5, "over-threshold", False, False, "YEARS"), 2: (None, None, False, False, None), 3: (3, "over-threshold", False, False, "YEARS"), 4: (None, None, False, False, None),
    5: (4, "over-threshold", False, False, "YEARS"), 6: (None, None, False, False, None), 7: (None, None, False, False, None), 8: (3, "over-threshold", False, False, "YEARS"),
    9: (1, "field-mismatch", False, False, "YEARS"), 10: (None, None, True, False, "DEGREE"), 11: (None, None, True, False, "DEGREE"), 12: (None, None, False, False, None),
    13: (None, None, False, True, "BODY LANGUAGE"), 14: (None, None, False, False, None), 15: (None, None, False, False, None), 16: (None, None, False, False, "DEFERRED"),
    17: (None, None, False, False, "DEFERRED"), 18: (None, None, False, False, None), 19: (None, None, False, False, None),
}
ANSWERED = {
    1: ("show", "fits", 0.8), 2: ("hide", "far", 0.8), 3: ("show", "vote: keep, confidence 0.4", 0.4), 4: ("show", "I would show it", 0.0), 5: (None, "show or hide? hard", 0.0),
    6: (None, "no idea", 0.0), 7: (None, "", 0.0), 8: (None, "unclear", 0.0), 9: ("hide", "", 0.0), 10: ("show", "", 1.0),
}


def test_screens_and_answers_of_the_literal_rows(spark):
    from quarryline.plans import text_queries

    sf = "/root/testdata/sf0.001"
    found = {r.id: (r.years, r.why, r.degree, r.language, r.stage) for r in text_queries.requirement_screens(spark, sf).collect()}
    assert {i: found[i] for i in DEMANDED} == DEMANDED and len(found) > 200
    found = {r.id: (r.vote, r.reason, r.confidence) for r in text_queries.judge_answers(spark, sf).collect()}
    assert {i: found[i] for i in ANSWERED} == ANSWERED and len(found) > 90


def test_spelled_numbers_to_fifteen():
    from quarryline.operators.screens import digits_for_words

    assert digits_for_words("nul tot drie jaar, quince años, fourteen years, une à deux ans") == "0 tot 3 jaar, 15 años, 14 years, 1 à 2 ans"


def test_screens_search_only_where_a_sign_stands():
    import re
    from types import SimpleNamespace

    from quarryline.plans import fixtures as fx
    from quarryline.operators import screens

    default = screens.Vocabulary()
    unsearched = {name: SimpleNamespace(pattern=p.pattern) for name, p in default.compiled().items()}  # searching one is an error
    text = "A quiet paragraph about rivers, lanterns and an old harbour."
    assert not screens.year_hits(text, unsearched) and not screens.several_years(text, unsearched) and not screens.language_block(text, unsearched)
    always = {name: re.compile(f"(?:{p.pattern})") for name, p in default.compiled().items()}  # no signs are known of these
    more = ["Fünf jahre Erfahrung erforderlich", "seven + years of experience required", "d'ans", "MSc required", "Deutsch fließend", "\n", None]
    for one_text in [row[2] for row in fx.DEMANDS.rows] + more:
        for screen in (screens.several_years, screens.language_block, lambda t, v: screens.degree_block(t, "Planner", v)):
            assert screen(one_text, default.compiled()) == screen(one_text, always)
    assert [h["n"] for t in more[:2] for h in screens.year_hits(t, always)] == [5, 7]
