from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarryline.operators import admission, discover, ledger, liveness, mail, present
from quarryline.operators.screens import Vocabulary, degree_block, language_block, several_years, year_hits

V = Vocabulary().compiled()


@pytest.mark.parametrize(
    ("text", "years"),
    [
        ("You must have 3-5 years of experience", [3]), ("1.5 years of experience required", [1]), ("2 or 5 years experience", [2]),
        ("3 or more years of experience", [3]), ("building on over 130 years of experience", []), ("mindestens fünf Jahre Erfahrung", [5]),
        ("null tot drie jaar ervaring", []), ("You don't need 5 years of experience", []), ("5 years of experience, ideally in offshore wind", [5]),
        ("5 years of experience, preferably", []), ("", []), (None, []),
    ],
)
def test_year_hits(text, years):
    assert [h["n"] for h in year_hits(text, V)] == years


def test_screens_read_long_hostile_text_quickly():
    import time

    began = time.time()
    for unit in ("5 years, ", "a" * 50 + " ", "master's degree, ", "fluent ", "(" * 30):
        text = unit * 4000
        year_hits(text, V), degree_block(text, "", V), language_block(text, V), several_years(text, V)
    assert time.time() - began < 30


def test_outage(spark):
    cases = [(10, 5, True), (10, 4, False), (3, 3, True), (2, 2, False), (11, 5, False), (0, 0, False)]
    rows = spark.createDataFrame(cases, "pending int, dead int, brake boolean")
    assert rows.filter(ledger.outage(F.col("pending"), F.col("dead")) != F.col("brake")).count() == 0


def test_ids_follow_the_mark_across_ranges(spark):
    rows = spark.createDataFrame([(s,) for s in (5, 1, 900_000, 42, 2)], "seq long")
    hwm = ledger.high_water(spark.createDataFrame([(7,), (None,), (-3,)], "id long"))
    found = {r.seq: r.id for r in ledger.assign_ids(rows, "seq", hwm).collect()}
    assert found == {1: 8, 2: 9, 5: 10, 42: 11, 900_000: 12}
    assert ledger.high_water(spark.createDataFrame([], "id long")).first().hwm == 0


def test_ledger_marks_and_undo(spark):
    pending = spark.createDataFrame([(1, False, False), (2, True, False), (3, False, False)], "id long, checked boolean, by_user boolean")
    asked = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    marked = {r.id: (r.checked, r.by_user) for r in ledger.mark_seen(pending, asked).collect()}
    assert marked == {1: (True, True), 2: (True, False), 3: (False, False)}
    assert sorted(r.id for r in ledger.missing_ids(pending, asked).collect()) == [2, 9]
    undone = ledger.restore(ledger.mark_seen(pending, asked), 1)
    assert undone.filter("id = 1 AND NOT checked AND NOT by_user").count() == 1


def test_remove_one_takes_the_last(spark):
    journal = spark.createDataFrame([(1, 10, dt.datetime(2024, 1, 1)), (2, 10, dt.datetime(2024, 1, 2)), (3, 11, dt.datetime(2024, 1, 3))], "seq long, id long, ts timestamp")
    assert sorted(r.seq for r in ledger.remove_one(journal, 10).collect()) == [1, 3]
    assert sorted(r.seq for r in ledger.remove_one(journal, 10, at="2024-01-01 00:00:00").collect()) == [2, 3]
    with pytest.raises(ValueError):
        ledger.checked_rewrite(journal, journal.limit(1))


def test_unknown_keeps_the_row(spark):
    gates = admission.Gates(companies=("spam",))
    offers = spark.createDataFrame([(1, "https://a.example", None, None, None), (2, None, "x", "y", "z")], "seq long, url string, company string, title string, location string")
    assert {r.seq: r.stage for r in admission.admit(offers, gates).collect()} == {1: "ADMITTED", 2: "NO LINK"}


def test_placeholder_employers_do_not_meet(spark):
    rows = [(i, f"https://a.example/{i}", "Aggregator", "Diver", "") for i in range(3)] + [(9, "https://a.example/9", "Gull", "Diver", ""), (10, "https://a.example/10", "GULL", "diver", "")]
    offers = spark.createDataFrame(rows, "seq long, url string, company string, title string, location string")
    stages = {r.seq: r.stage for r in admission.admit(offers, admission.Gates()).collect()}
    assert [s for s, stage in sorted(stages.items()) if stage == "DUPLICATE"] == [10]


def test_history_blocks(spark):
    offers = spark.createDataFrame([(1, "https://a.example/1?x", "A", "B", ""), (2, "https://a.example/2", "C", "D", "")], "seq long, url string, company string, title string, location string")
    urls = spark.createDataFrame([("https://a.example/1",)], "url_key string")
    roles = spark.createDataFrame([("c::d",), (None,)], "role_key string")
    reasons = {r.seq: r.reason for r in admission.admit(offers, admission.Gates(), urls, roles).collect()}
    assert reasons == {1: "already seen (same link)", 2: "already seen (same company and role)"}


def test_message_window_and_silence(spark):
    applied = dt.datetime(2024, 1, 10)
    messages = [(1, applied - dt.timedelta(days=2)), (2, applied - dt.timedelta(days=2, seconds=1))]
    m = spark.createDataFrame([(i, "", "", "about Tidalworks", "", d, "acknowledged") for i, d in messages], "id long, subject string, snippet string, body string, from string, date timestamp, kind string")
    a = spark.createDataFrame([(7, "Tidalworks", "Diver", "", applied)], "id long, company string, title string, location string, ts timestamp")
    assert [r.message_id for r in mail.score_links(m, a).collect()] == [1]
    apps = spark.createDataFrame([(7, applied, False)], "id long, ts timestamp, longshot boolean")
    events = spark.createDataFrame([], "app_id long, kind string, at timestamp")
    state = lambda days: mail.application_states(apps, events, F.lit(applied + dt.timedelta(days=days)).cast("timestamp")).first().state
    assert state(59.99) == "noreply" and state(60) == "ghosted"


def test_ties_link_only_bounces(spark):
    m = spark.createDataFrame([(1, "acknowledged"), (2, "bounced"), (3, "rejected")], "id long, kind string")
    s = spark.createDataFrame([(1, 7, 10, 13), (1, 8, 10, 11), (2, 7, 10, 13), (2, 8, 10, 11)], "message_id long, app_id long, identity int, score int")
    found = sorted((r.message_id, r.app_id or 0, r.outcome) for r in mail.resolve_links(m, s).collect())
    assert found == [(1, 7, "tie"), (1, 8, "tie"), (2, 7, "link"), (2, 8, "link"), (3, 0, "orphan")]


def test_portals_and_dead(spark):
    rows = [("api_list", 200, False, "", True), ("api_list", 500, None, "", False), ("api_item", 403, None, "", True), ("details", 403, None, "", False), ("details", 410, None, "", True), ("card", 200, True, "No longer accepting applications", True)]
    df = spark.createDataFrame(rows, "p string, s int, i boolean, b string, dead boolean")
    assert df.filter(F.coalesce(liveness.portal_dead(F.col("p"), F.col("s"), F.col("i"), F.col("b")), F.lit(False)) != F.col("dead")).count() == 0


def test_merge_drops_keeps_undated_and_caps(spark):
    store = spark.createDataFrame([("old", "Old", "w", "rule", 3, None, None), ("gone", "Gone", "w", "rule", 9, dt.date(2023, 1, 1), dt.date(2023, 1, 1))], "key string, title string, why string, bucket string, n long, first date, last date")
    drops = spark.createDataFrame([("New ", "x", None, 1), ("new", "y", None, 2), ("", "z", None, 3)], "title string, why string, bucket string, seq long")
    found = {r.key: (r.title, r.why, r.n) for r in discover.merge_drops(store, drops, F.lit("2024-03-01").cast("date")).collect()}
    assert found == {"old": ("Old", "w", 3), "new": ("New ", "y", 2)}
    assert discover.merge_drops(store, drops, F.lit("2024-03-01").cast("date"), most=1).first().key == "old"


def test_pages_and_budget(spark):
    rows = spark.createDataFrame([(1, i, size) for i, size in enumerate([50, 60, 200, 10, 90, 1])], "k long, i long, size long")
    packed = present.pack_rows(rows, "k", ("i",), "size", 100)
    assert packed.columns == ["k", "i", "size", "page"] and [r.page for r in packed.orderBy("i").collect()] == [1, 2, 3, 4, 4, 5]
    assert sorted(r.i for r in present.within_budget(rows, "size", 110, ("i",)).collect()) == [0, 1]


def test_funnel_adds_up(spark):
    from quarryline.plans.funnel_queries import GATES, page_offers

    offers = page_offers(spark, "/root/testdata/sf0.001")
    counts = admission.funnel_counts(admission.admit(offers, GATES)).collect()
    assert sum(r.n for r in counts) == offers.count() and len([r for r in counts if r.n]) >= 3


def test_links_broadcast_no_exploded_words(spark, tmp_path):
    """Spark sizes words of messages by their table, so it would broadcast them whatever there are."""
    m = spark.createDataFrame([(i, "", "", f"about Tidalworks, from its divers {i}", "", dt.datetime(2024, 1, 10), "acknowledged") for i in range(3)], "id long, subject string, snippet string, body string, from string, date timestamp, kind string")
    a = spark.createDataFrame([(7, "Tidal Works", "Divers, about", "", dt.datetime(2024, 1, 9)), (8, "Nobody", "Cook", "", dt.datetime(2024, 1, 9))], "id long, company string, title string, location string, ts timestamp")
    m.write.parquet(f"{tmp_path}/m")  # rows from Python have no size
    a.write.parquet(f"{tmp_path}/a")
    links = mail.score_links(spark.read.parquet(f"{tmp_path}/m"), spark.read.parquet(f"{tmp_path}/a"))
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.message_id, r.app_id, r.identity, r.score) for r in links.collect()) == [(i, 7, 13, 16) for i in range(3)]
