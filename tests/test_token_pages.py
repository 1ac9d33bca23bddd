"""Chains of pages as a stream and a listing, boards that stop, and control tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarryline.sources import boards, control
from quarryline.sources.token_pages import TokenPages


class Pages:
    """A service whose pages are in a JSON file: {channel: {"latest": token, "pages": {token: [rows, next]}}}."""

    def __init__(self, path):
        with open(path) as file:
            self.channels = json.load(file)

    def first(self, channel):
        return self.channels[channel].get("first", "0")

    def latest(self, channel):
        return self.channels[channel]["latest"]

    def page(self, channel, token):
        return self.channels[channel]["pages"].get(token)


def publish(path, **channels):
    """Channels of numbered pages: a chain from 0 to the latest token, which has no page yet."""
    told = {}
    for name, (pages, gone) in channels.items():
        chain = {str(i): [rows, str(i + 1)] for i, rows in enumerate(pages) if i not in gone}
        told[name] = {"latest": str(len(pages)), "pages": chain}
    path.write_text(json.dumps(told))


def run(spark, tmp_path, channels, **options):
    spark.dataSource.register(TokenPages)
    stream = spark.readStream.format("token_pages").option("api", "tests.test_token_pages:Pages").option("service", str(tmp_path / "pages.json")).option("channels", json.dumps(channels))
    for name, value in options.items():
        stream = stream.option(name, value)
    query = stream.load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted((r.channel, r.token, r.payload or "", r.lost) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    publish(tmp_path / "pages.json", a=([["x"], ["y", "z"]], ()), b=([["m"]], ()))
    # a stream without a log starts at the latest tokens
    assert run(spark, tmp_path, ["a", "b"], **{"from": "first"}) == [("a", "0", "x", False), ("a", "1", "y", False), ("a", "1", "z", False), ("b", "0", "m", False)]
    publish(tmp_path / "pages.json", a=([["x"], ["y", "z"], [], ["w"]], ()), b=([["m"]], ()))
    found = run(spark, tmp_path, ["a", "b"], **{"from": "first"})
    assert found[3:4] == [("a", "3", "w", False)] and len(found) == 5
    assert run(spark, tmp_path, ["a", "b"], **{"from": "first"}) == found


def test_a_new_stream_replays_nothing(spark, tmp_path):
    publish(tmp_path / "pages.json", a=([["x"], ["y"]], ()))
    run_one = lambda: run(spark, tmp_path, ["a"])
    spark.createDataFrame([], "channel string, token string, payload string, lost boolean").write.parquet(str(tmp_path / "out"))
    assert run_one() == []
    publish(tmp_path / "pages.json", a=([["x"], ["y"], ["new"]], ()))
    assert run_one() == [("a", "2", "new", False)]


def test_a_lost_token_goes_on_from_the_latest(spark, tmp_path):
    publish(tmp_path / "pages.json", a=([["x"]], ()))
    assert run(spark, tmp_path, ["a"], **{"from": "first"}) == [("a", "0", "x", False)]
    publish(tmp_path / "pages.json", a=([["x"], ["gone"], ["gone too"]], (0, 1, 2)))
    assert run(spark, tmp_path, ["a"])[1:] == [("a", "1", "", True)]
    publish(tmp_path / "pages.json", a=([["x"], ["gone"], ["gone too"], ["after"]], (0, 1, 2)))
    assert run(spark, tmp_path, ["a"])[2:] == [("a", "3", "after", False)]


def test_listings_follow_tokens(spark, tmp_path):
    spark.dataSource.register(TokenPages)
    publish(tmp_path / "pages.json", a=([[f"m{i}{j}" for j in range(3)] for i in range(30)], ()), b=([], ()))

    def listed(**options):
        rows = spark.read.format("token_pages").option("api", "tests.test_token_pages:Pages").option("service", str(tmp_path / "pages.json"))
        return [r.payload for r in rows.options(channels='["a", "b"]', **options).load().filter("NOT lost").collect()]

    assert listed(most=7) == ["m00", "m01", "m02", "m10", "m11", "m12", "m20"]
    assert len(listed(most=1000)) == 60 and len(listed(most=1000, max_pages=50)) == 90


ANSWERS = {
    "https://a/tide/0": (200, {"items": [{"url": "u1", "n": 1}, {"url": "u2"}], "total": 3}), "https://a/tide/2": (200, {"items": [{"url": "u3"}], "total": 3}),
    "https://a/sea/0": (200, {"items": [{"url": "u1", "n": 2}, {"url": ""}], "total": 2}),
    "https://b/x/0": (200, {"items": [{"url": "v1"}, {"url": "v2"}], "total": 9}), "https://b/x/2": (503, "no"), "https://b/y/0": (200, {"items": [], "total": 0}),
    "https://c/x/0": (403, "no"), "https://c/y/0": (403, "no"), "https://d/x/0": (0, None), "https://e/x/0": (200, {"items": [{"url": "w1"}, {"url": "w2"}], "total": 9}),
    "https://e/x/2": (429, "slow"), "https://g//0": (200, "not json"),
}


def fetch(url):
    status, body = ANSWERS[url]
    return status, json.dumps(body) if isinstance(body, dict) else body


def test_boards_stop_and_say_so(spark):
    spark.dataSource.register(boards.Boards)
    board = lambda name, host, *terms: {"name": name, "host": host, "url": f"https://{host}/{{term}}/{{offset}}", "page": 2, "most": 6, "terms": list(terms)}
    asked = [board("A", "a", "tide", "sea"), board("B", "b", "x", "y"), board("C", "c", "x", "y"), board("D", "d", "x"), board("E", "e", "x", "never"), board("F", "e", "x"), board("G", "g")]
    rows = spark.read.format("boards").option("fetch", "tests.test_token_pages:fetch").option("boards", json.dumps(asked)).load()
    assert rows.rdd.getNumPartitions() == 6
    items = sorted((r.board, r.address, r.term, json.loads(r.item).get("n")) for r in boards.board_items(rows).collect())
    assert items == [("A", "u1", "sea", 2), ("A", "u2", "tide", None), ("A", "u3", "tide", None), ("B", "v1", "x", None), ("B", "v2", "x", None), ("E", "w1", "x", None), ("E", "w2", "x", None)]
    report = boards.board_report(rows)
    assert sorted(tuple(r) for r in report.collect()) == [
        ("A", 3, 3, 0, 200, False, "ran"), ("B", 2, 3, 1, 200, True, "ran"), ("C", 0, 2, 2, 403, False, "blocked"), ("D", 0, 1, 1, 0, False, "no answer"),
        ("E", 2, 2, 1, 429, True, "rate limited"), ("F", 0, 0, 0, 0, False, "not asked"), ("G", 0, 1, 1, 200, False, "no answer"),
    ]
    rests = {r.board: r.cooldown_until for r in boards.next_run(report, F.lit(1000), 50).collect()}
    assert rests == {"A": None, "B": None, "C": None, "D": None, "E": 1050, "G": None}


def test_two_writers_one_wins_and_no_row_is_lost(spark, tmp_path):
    table = control.id_table(spark, str(tmp_path / "ids"))
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    assert not table.was_set() and table.read()[0] == 0 and control.high_water(table) == 0
    assert table.write(one(1), 0) == 1 and table.was_set()
    version, rows = table.read()
    assert table.write(rows.unionByName(one(2)), version) == 2
    with pytest.raises(control.Conflict):
        table.write(rows.unionByName(one(3)), version)

    def merge(held):
        if table.read()[0] == 2:  # another writer is faster while this one merges
            table.write(held.unionByName(one(4)), 2)
        return held.unionByName(one(3))

    assert table.update(merge) == 4
    assert sorted(r.id for r in table.read()[1].collect()) == [1, 2, 3, 4]


def test_what_cannot_be_read_is_no_version(spark, tmp_path):
    table = control.id_table(spark, str(tmp_path / "ids"))
    for i in range(1, 9):
        control.save_high_water(table, i)
    assert control.high_water(table) == 8 and len(table.versions()) == control.KEPT
    (tmp_path / "ids" / "pointers" / f"{9:012d}").write_text("")
    (tmp_path / "ids" / "pointers" / f"{10:012d}").write_text("no-such-folder")
    assert table.read()[0] == 8 and control.high_water(table) == 8
    assert control.save_high_water(table, 3) == 11 and control.high_water(table) == 8
    for wrong in (0, -1, True, 1.5, None):
        with pytest.raises(ValueError):
            control.save_high_water(table, wrong)
    empty = control.recurrence_table(spark, str(tmp_path / "store"))
    assert empty.read()[1].count() == 0 and empty.write(empty.read()[1], 0) == 1 and empty.was_set()
