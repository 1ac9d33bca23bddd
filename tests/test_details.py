"""Requests and texts of single offers, and the nested sections of their pages."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from quarryline.sources import details


@pytest.mark.parametrize(
    ("url", "kind", "asked"),
    [
        ("https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/Lyon/Diver_R-1", "workday", "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Ext/job/Lyon/Diver_R-1"),
        ("https://x.fa.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX_1/requisitions/preview/42", "oracle",
         "https://x.fa.oraclecloud.com/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?onlyData=true&finder=ById;Id=%2242%22,siteNumber=%22CX_1%22"),
        ("https://be.linkedin.com/jobs/view/77?trk=x", "guest", "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/77"),
        ("https://www.adzuna.co.uk/details/5", "aggregator", "https://www.adzuna.co.uk/details/5"),
        ("https://notadzuna.example/x", "page", "https://notadzuna.example/x"), ("ftp://x", None, None), (None, None, None), ("", None, None),
    ],
)
def test_routes(spark, url, kind, asked):
    row = spark.createDataFrame([(url,)], "url string").select(details.recipe("url").alias("r"), details.request_url("url").alias("u")).first()
    assert (row.r, row.u) == (kind, asked)


def test_a_hosts_requests_stand_apart_whatever_the_number_of_ranges(spark):
    hosts = ["a", "b", "hot"]
    rows = [(i, f"https://{hosts[0 if i % 50 == 1 else 1 if i % 50 == 2 else 2]}.example/{i}", "had" if i % 10 == 0 else None) for i in range(3000)]
    offers = spark.createDataFrame(rows, "seq long, url string, jd string").repartition(5)
    found = details.request_plan(offers, "seq", known=F.col("jd")).collect()
    assert len(found) == 2700
    for host in hosts:
        mine = sorted((r.seq, r.at_ms) for r in found if r.host == f"{host}.example")
        assert [at for _, at in mine] == [1200 * i for i in range(len(mine))]


@pytest.mark.parametrize(
    ("html", "inside"),
    [
        ('<section class="a adp-body b">x<section>y</section>z</section>w', "x<section>y</section>z"),
        ("<SECTION id=1 CLASS = 'adp-body'>x", "x"),
        ('<section class="adp-body">x<section>y</section>', "x<section>y</section>"),
        ('<section class="adp-bodyguard">x</section>', ""), ('<section data-class="adp-body">x</section>', ""), ('<div class="adp-body">x</div>', ""),
        ('<section class="adp-body">1 < 2 <section broken <p>x</p></section>w', "1 < 2 <section broken <p>x</p>"),
        ('<section class="adp-body">x<sectional>y</sectional></section>w', "x<sectional>y</sectional>"),
        ('<section>a</section><section class="adp-body">x</section>', "x"), ("", ""), (None, ""),
    ],
)
def test_sections(spark, html, inside):
    found = spark.createDataFrame([(html,)], "html string").select(details.nested_section("html", "section", "adp-body"))
    assert found.first()[0] == inside


def test_unclosed_sections_take_linear_time(spark):
    def seconds(n):
        rows = spark.createDataFrame([('<section class="adp-body">' + "<section x='" * n,), ('<section class="adp-body">' + "<section>" * n,)], "html string")
        began = time.time()
        rows.select(F.length(details.nested_section("html", "section", "adp-body"))).collect()
        return time.time() - began

    seconds(10)
    assert seconds(60_000) < 3


def test_bodies(spark):
    job = json.dumps({"jobPostingInfo": {"jobDescription": "<p>Dive&nbsp;deep</p>"}})
    sections = json.dumps({"items": [{"ExternalQualificationsStr": "<li>One</li>", "ExternalResponsibilitiesStr": "", "CorporateDescriptionStr": "Two"}]})
    page = '<nav>menu</nav><section class="adp-body">Clean <b>text</b></section>'
    a, w, o = "https://www.adzuna.fr/1", "https://a.wd1.myworkdayjobs.com/en-US/s/1", "https://x.oraclecloud.com/hcmUI/CandidateExperience/e/sites/S/requisitions/preview/1"
    offers = [
        (1, w, "own", None), (2, o, "own", None), (3, a, "short", None), (4, a, "short", None), (5, a, "short", None), (6, "https://p.example/1", "own", None),
        (7, w, "own", "known"), (8, w, "own", None), (9, None, "<p>own</p>", None), (10, "https://p.example/2", None, None),
    ]
    answers = [
        (1, 200, job, 1), (2, 200, sections, 1), (3, 200, page, 1), (4, 200, "<p>whole page</p>", 1), (5, 429, None, 1), (6, 403, "no", 1), (6, 200, "<p>Page</p>", 2),
        (6, 500, "x", 3), (8, 200, "not json", 1), (10, 404, "gone", 1),
    ]
    found = details.detail_bodies(
        spark.createDataFrame(offers, "seq long, url string, description string, jd string"), spark.createDataFrame(answers, "seq long, status int, payload string, tries int"), "seq"
    )
    assert sorted((r.seq, r.body, r.clean, r.unread, r.status) for r in found.collect()) == [
        (1, "Dive deep", False, False, 200), (2, "One. Two", False, False, 200), (3, "short Clean text", True, False, 200), (4, "short whole page", False, False, 200),
        (5, "short", False, True, 429), (6, "Page", False, False, 200), (7, "known", False, False, None), (8, "own", False, False, 200), (9, "own", False, False, None),
        (10, "", False, False, 404),
    ]
