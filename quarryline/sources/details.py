"""Texts of single offers: how each is asked for, when, and what its answer says.

No request is made here. A plan says which address answers for an offer and at what time of its
host's calendar it may be asked; the answers come back as rows with a status and a payload, and
:func:`detail_bodies` reads their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import html_text
from quarryline.operators.ordering import running

# fixed values: shapes of public addresses of offers and of the services that answer for them
WORKDAY = r"^https://([^./]+)\.(wd\d+)\.myworkdayjobs\.com/en-US/([^/]+)(/.+)$"
ORACLE = r"^https://([^/]+oraclecloud\.com)/hcmUI/CandidateExperience/[^/]+/sites/([^/]+)/requisitions/preview/(\d+)"
GUEST = r"linkedin\.com/jobs/view/(\d+)"
AGGREGATOR = r"^https?://(?:[^/]*\.)?adzuna\.[a-z.]+/"
GUEST_PAGE = "https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/"
ORACLE_SERVICE = "/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?onlyData=true&finder=ById;Id=%22"
#: Sections of an answer that make up the text together, in order.
ORACLE_SECTIONS = ("ExternalQualificationsStr", "ExternalResponsibilitiesStr", "ExternalDescriptionStr", "CorporateDescriptionStr")
#: The element of an aggregator's page that holds the offer.
REGION = ("section", "adp-body")
#: Milliseconds between two requests to a host, by recipe; 1200 for all others.
GAPS = {"workday": 500, "oracle": 500}
OTHER_GAP = 1200


def nested_section(html: Column | str, tag: str, name: str) -> Column:
    """The inside of the first ``tag`` with the class ``name``, up to the tag that closes it; to the end if none does, empty without it.

    Tags of the same kind within it open and close, so the text is cut where the running sum of
    their depths returns to its start. Markup is cut at its opening brackets, and what has no
    closing bracket before the next opening one is no tag; each piece is looked at once.
    """
    pieces = F.split(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), "<")
    closed = lambda piece: F.contains(piece, F.lit(">"))
    inside = lambda piece: F.lower(F.substring_index(piece, ">", 1))
    opening = rf"^{tag}\b[\s\S]*\sclass\s*=\s*(?:'[^']*(?<![\w-]){name}(?![\w-])[^']*'|\"[^\"]*(?<![\w-]){name}(?![\w-])[^\"]*\")"
    rest = F.slice(pieces, F.lit(2), F.size(pieces))
    marked = F.transform(rest, lambda piece: closed(piece) & F.rlike(inside(piece), F.lit(opening)))
    first = F.array_position(marked, True)
    after = F.slice(rest, F.greatest(first, F.lit(1)).cast("int") + 1, F.size(pieces))

    def depth(piece: Column) -> Column:
        opens, closes = F.rlike(inside(piece), F.lit(rf"^{tag}\b")), F.rlike(inside(piece), F.lit(rf"^/{tag}\b"))
        return F.when(~closed(piece), 0).when(opens, 1).when(closes, -1).otherwise(0)

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("end"))

    def step(state: Column, piece: Column) -> Column:
        now = state["depth"] + depth(piece)
        return F.struct(
            now.alias("depth"), (state["seen"] + 1).alias("seen"), F.coalesce(state["end"], F.when(now == 0, state["seen"])).alias("end")
        )

    end = F.aggregate(after, start, step, lambda state: state["end"])
    opened = F.element_at(rest, F.greatest(first, F.lit(1)).cast("int"))
    head = F.substring(opened, F.length(F.substring_index(opened, ">", 1)) + F.lit(2), F.length(opened))
    body = F.array_join(F.concat(F.array(head), F.slice(after, F.lit(1), F.coalesce(end, F.size(after)))), "<")
    return F.when(first > 0, body).otherwise("")


def recipe(url: Column | str) -> Column:
    """By the shape of an address: workday, oracle, guest, aggregator, or page for any other; null without an address."""
    u = F.col(url) if isinstance(url, str) else url
    return (
        F.when(u.rlike(WORKDAY), "workday").when(u.rlike(ORACLE), "oracle").when(u.rlike(GUEST), "guest")
        .when(u.rlike(AGGREGATOR), "aggregator").when(u.rlike("^https?://[^/]"), "page")
    )


def request_url(url: Column | str) -> Column:
    """The address that answers with the whole text of an offer."""
    u = F.col(url) if isinstance(url, str) else url
    workday = [F.regexp_extract(u, WORKDAY, i) for i in range(1, 5)]
    oracle = [F.regexp_extract(u, ORACLE, i) for i in range(1, 4)]
    kind = recipe(u)
    return (
        F.when(kind == "workday", F.format_string("https://%s.%s.myworkdayjobs.com/wday/cxs/%s/%s%s", workday[0], workday[1], workday[0], workday[2], workday[3]))
        .when(kind == "oracle", F.concat(F.lit("https://"), oracle[0], F.lit(ORACLE_SERVICE), oracle[2], F.lit("%22,siteNumber=%22"), oracle[1], F.lit("%22")))
        .when(kind == "guest", F.concat(F.lit(GUEST_PAGE), F.regexp_extract(u, GUEST, 1)))
        .when(kind.isNotNull(), u)
    )


def request_plan(offers: DataFrame, seq: str, url: str = "url", known: Column | None = None) -> DataFrame:
    """(seq, recipe, host, request_url, at_ms) of the offers whose text has to be asked for.

    ``known`` is a text that was read before; offers that have one are not asked for. A host's
    requests stand apart by the sum of the gaps before them, in the order of ``seq``, from its first
    at nought. Prefix sums are taken over ranges of hosts, so a host with very many offers is planned
    by many tasks; whoever sends the requests may deal out hosts, or stretches of their calendar.
    """
    asked = offers if known is None else offers.filter(F.coalesce(F.trim(known), F.lit("")) == "")
    rows = asked.select(F.col(seq).alias("seq"), recipe(url).alias("recipe"), request_url(url).alias("request_url")).filter("recipe IS NOT NULL")
    gap = F.lit(OTHER_GAP)
    for name, milliseconds in GAPS.items():
        gap = F.when(F.col("recipe") == name, milliseconds).otherwise(gap)
    rows = rows.withColumns({"host": F.lower(F.regexp_extract("request_url", "^https?://([^/?#]+)", 1)), "gap": gap.cast("long")})
    summed = running(rows, ("host",), ("seq",), "gap", "upto")
    return summed.select("seq", "recipe", "host", "request_url", (F.col("upto") - F.col("gap")).alias("at_ms"))


def detail_text(kind: Column, payload: Column, region: Column) -> Column:
    """The text of an answer, by recipe; ``region`` is the text of an aggregator's offer on its page. Empty if nothing fits."""
    page = F.coalesce(payload, F.lit(""))
    oracle = [F.nullif(F.get_json_object(page, f"$.items[0].{name}"), F.lit("")) for name in ORACLE_SECTIONS]
    markup = (
        F.when(kind == "workday", F.get_json_object(page, "$.jobPostingInfo.jobDescription"))
        .when(kind == "oracle", F.concat_ws(" ", *oracle))
        .when(kind.isNotNull(), page)
    )
    return F.when((kind == "aggregator") & (region != ""), region).otherwise(html_text(F.coalesce(markup, F.lit(""))))


def detail_bodies(offers: DataFrame, answers: DataFrame, seq: str, url: str = "url") -> DataFrame:
    """(seq, recipe, body, clean, unread, status) of offers (seq, url, description, known text ``jd``) and answers (seq, status, payload, tries).

    A text read before wins, then the answer, then the offer's own description. Of an aggregator the
    description stands before the page, and ``clean`` says that the page's region was found (only then is
    the language of the body told from it). ``unread`` is true where no answer came (null or 429): such
    an offer is deferred, not judged. An answer other than 200 has no text, but its status is evidence.
    Of several answers to an offer the best counts: a 200 with a text before any other, then the last try.
    """
    rank = F.struct(((F.col("status") == 200) & (F.trim(F.coalesce("payload", F.lit(""))) != "")).alias("good"), F.col("tries").alias("tries"))
    best = answers.groupBy(F.col("seq").alias("a_seq")).agg(F.max_by(F.struct("status", "payload"), rank).alias("answer"))
    rows = offers.select(F.col(seq).alias("seq"), F.col(url).alias("u"), html_text("description").alias("own"), F.coalesce("jd", F.lit("")).alias("jd"))
    met = rows.join(best, F.col("seq") == F.col("a_seq"), "left").select("seq", "own", "jd", recipe("u").alias("recipe"), "answer.status", "answer.payload")
    ok = (F.col("status") == 200) & F.col("recipe").isNotNull()
    met = met.withColumn("section", F.when(ok & (F.col("recipe") == "aggregator"), nested_section("payload", *REGION)).otherwise(""))
    met = met.withColumn("region", html_text("section")).withColumn("told", F.when(ok, detail_text(F.col("recipe"), F.col("payload"), F.col("region"))).otherwise(""))
    had = F.col("jd") != ""
    told = F.when(F.col("recipe") == "aggregator", F.trim(F.concat("own", F.lit(" "), "told"))).when(F.col("told") != "", F.col("told")).otherwise(F.col("own"))
    missed = F.col("status").isNull() | (F.col("status") == 429)
    return met.select(
        "seq", "recipe", F.when(had, F.col("jd")).otherwise(told).alias("body"), (~had & (F.col("region") != "")).alias("clean"),
        (~had & F.col("recipe").isNotNull() & missed).alias("unread"), "status",
    )
