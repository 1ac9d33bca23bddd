from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import functions as F

from quarryline.sources import feeds, journals, mailbox
from quarryline.sources.paged import PagedFeeds

PAGES = {
    "good": [200, 200, 200], "cut": [200, 503], "dead": [404], "busy": [429],
}


def fake_fetch(url: str):
    name, offset = url.split("://")[1].split("/")
    page = int(offset) // 2
    status = PAGES[name][page] if page < len(PAGES[name]) else 200
    items = [1, 2] if page < 2 else [1]
    return status, json.dumps({"items": items})


def test_paged_source(spark):
    spark.dataSource.register(PagedFeeds)
    listed = json.dumps([{"name": n, "url": f"x://{n}/{{offset}}"} for n in PAGES])
    rows = spark.read.format("paged_feeds").option("feeds", listed).option("fetch", "tests.test_sources:fake_fetch").option("page_size", 2).option("most", 8).option("pause", 0).load()
    found = sorted((r.feed, r.page, r.status, r.partial) for r in rows.collect())
    assert found == [("busy", 0, 429, False), ("cut", 0, 200, False), ("cut", 1, 503, True), ("dead", 0, 404, False), ("good", 0, 200, False), ("good", 1, 200, False), ("good", 2, 200, False)]


def test_pending_list_round_trip(spark):
    lines = ["- [ ] https://a.example/1 | Gull | Diver | Bergen | y:2 | s:€40k | #7", "- [x] https://a.example/2 | Reed | Cook | #8 | visto", "- [x] https://a.example/3 | Reed | Sailor | #9", "## Processed", "junk"]
    rows = journals.parse_pending(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string"))
    assert [r.line for r in rows.orderBy("line_no").select(journals.pending_line().alias("line")).collect()] == lines[:3]
    assert sorted(r.role_key for r in journals.blocking_roles(rows).collect()) == ["gull::diver", "reed::cook"]


def test_jsonl_skips_broken_lines(spark, tmp_path):
    path = tmp_path / "verdicts.jsonl"
    path.write_text('{"id": 1, "state": "rejected", "ts": "2024-01-01T00:00:00Z"}\n{broken\n\n{"id": 2}\n')
    assert sorted(r.id for r in journals.read_jsonl(spark, str(path), journals.VERDICT).collect()) == [1, 2]


def test_history_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("u", dt.date(2024, 1, 2), "board", "Diver", "Gull", "added", "Bergen")], journals.HISTORY)
    journals.append_history(rows, str(tmp_path / "h"))
    journals.append_history(rows, str(tmp_path / "h"))
    assert journals.read_history(spark, str(tmp_path / "h")).count() == 2


def test_messages(spark):
    encode = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    tree = {"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": encode("<p>rich</p>")}}, {"mimeType": "multipart/mixed", "parts": [{"mimeType": "text/plain", "body": {"data": encode("plain é")}}]}]}
    only = {"mimeType": "text/html", "body": {"data": encode("<p>rich</p>")}}
    head = [("from", "a@b.example"), ("Subject", "Hi"), ("DATE", "Tue, 2 Jan 2024 03:04:05 +0100")]
    raw = spark.createDataFrame([("1", "s", head, json.dumps(tree)), ("2", "s", head, json.dumps(only)), ("3", "s", [], "{"), ("4", None, None, None)], "id string, snippet string, headers array<struct<name:string,value:string>>, payload string")
    rows = {r.id: r for r in mailbox.message_rows(raw).collect()}
    assert rows["1"].body == "plain é" and rows["2"].body == "rich" and rows["3"].body == "" and rows["4"].body == ""
    assert rows["1"].subject == "Hi" and rows["1"].date == dt.datetime(2024, 1, 2, 2, 4, 5)


def test_sitemap_filters_before_fetch(spark):
    xml = "".join(f"<loc>https://a.example/jobs/{s}</loc>" for s in ("tide-clerk-1en", "cook-2", "tide-guard-3")) + "<loc>https://a.example/about</loc>"
    found = feeds.pages_to_fetch(spark.createDataFrame([("a", xml)], "site string, xml string"), lambda s: F.contains(s, F.lit("tide")), match="/jobs/", most=1)
    assert [r.slug for r in found.collect()] == ["tide clerk"]


def test_aggregator(spark):
    payload = json.dumps({"results": [{"id": "5", "title": "Diver", "redirect_url": "https://www.aggregator.es/land/ad/5?x", "company": None, "location": {"display_name": "Vigo", "area": ["Spain"]}, "salary_min": 80000, "salary_max": 20000, "salary_is_predicted": "1"}]})
    row = feeds.parse_aggregator(spark.createDataFrame([("es", payload)], "country string, payload string")).first()
    assert (row.company, row.url, row.location, row.salary) == ("Aggregator", "https://www.aggregator.es/details/5", "Vigo, Spain", "~€20-80k")


def test_feed_kinds(spark):
    rows = [("workday", None, None, "workday"), (None, "https://x.greenhouse.io/api", None, "greenhouse"), (None, None, "https://a.example/sitemap.xml", "sitemap"), (None, None, "https://jobs.lever.co/gull", "lever"), (None, None, "https://a.example", None)]
    df = spark.createDataFrame(rows, "e string, a string, u string, kind string")
    assert df.filter(~feeds.feed_kind(F.col("e"), F.col("a"), F.col("u")).eqNullSafe(F.col("kind"))).count() == 0
