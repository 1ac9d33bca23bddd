"""Queries of ledger marks, headings, portals, addresses, dates and tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import scalars, text
from quarryline.operators import council, discover, ledger, liveness, present
from quarryline.operators.rules import Country
from quarryline.plans.funnel_queries import D_COUNCIL, journal_and_decisions, query
from quarryline.session import table
from quarryline.sources import feeds

# orders are offers of a list: finished ones are checked, some by the user; clicks and views ask for marks
D_PENDING = "pending AS (SELECT o_orderkey AS id, o_orderstatus = 'F' AS checked, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS by_user FROM orders), asked AS (SELECT DISTINCT event_id * 3 AS id FROM events WHERE event_type IN ('click', 'view'))"


def pending(spark, sf_dir):
    done, mine = F.col("o_orderstatus") == "F", F.col("o_orderkey") % 2 == 0
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), done.alias("checked"), (done & mine).alias("by_user"))
    return rows, table(spark, sf_dir, "events").filter("event_type IN ('click', 'view')").select((F.col("event_id") * 3).alias("id"))


@query("marked_seen", f"WITH {D_PENDING} SELECT p.id, checked OR a.id IS NOT NULL AS checked, by_user OR (a.id IS NOT NULL AND NOT checked) AS by_user FROM pending p LEFT JOIN asked a USING (id)")
def marked_seen(spark, sf_dir):
    return ledger.mark_seen(*pending(spark, sf_dir))


@query("marks_missing", f"WITH {D_PENDING} SELECT id FROM asked WHERE id NOT IN (SELECT id FROM pending WHERE NOT checked)")
def marks_missing(spark, sf_dir):
    return ledger.missing_ids(*pending(spark, sf_dir))


@query("mark_undone", f"WITH {D_PENDING}, u AS (SELECT max(id) AS id FROM pending WHERE by_user) SELECT p.id, checked AND p.id <> u.id AS checked, by_user AND p.id <> u.id AS by_user FROM pending p, u")
def mark_undone(spark, sf_dir):
    rows, _ = pending(spark, sf_dir)
    newest = rows.filter("by_user").agg(F.max("id")).first()[0]
    return ledger.restore(rows, newest)


@query("record_removed", "SELECT event_id, user_id FROM events WHERE event_id <> (SELECT max(event_id) FROM events WHERE user_id = 7)")
def record_removed(spark, sf_dir):
    journal = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("id"))
    return ledger.remove_one(journal, 7, "event_id").select("event_id", F.col("id").alias("user_id"))


@query("history_rows", "SELECT 'u' || doc_id AS url, DATE '2024-03-05' AS first_seen, source AS portal, lang AS title, '' AS company, CASE doc_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'dup' ELSE 'filtered' END AS status, 'x' AS location FROM documents")
def history_rows(spark, sf_dir):
    stage = F.when(F.col("doc_id") % 3 == 0, "ADMITTED").when(F.col("doc_id") % 3 == 1, "DUPLICATE").otherwise("TITLE")
    offers = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "source", F.col("lang").alias("title"), F.lit("").alias("company"), stage.alias("stage"), F.lit("x").alias("location")
    )
    return ledger.history_rows(offers, F.lit("2024-03-05").cast("date"))


@query("letter_names", """WITH b AS (SELECT c_custkey, left('Reed_' || array_to_string(list_transform(list_filter(regexp_split_to_array(c_mktsegment || ' & ' || c_custkey % 7 || ' co.', '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: upper(left(w, 1)) || substr(w, 2)), ''), 40) AS base FROM customer),
 n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY c_custkey) AS place FROM b) SELECT c_custkey, base || CASE WHEN place > 1 THEN '_' || place ELSE '' END AS name FROM n""")
def letter_names(spark, sf_dir):
    company = F.concat("c_mktsegment", F.lit(" & "), (F.col("c_custkey") % 7).cast("string"), F.lit(" co."))
    rows = table(spark, sf_dir, "customer").select("c_custkey", ledger.file_names(company, "Reed").alias("base"))
    return ledger.unique_names(rows, "base", "c_custkey").select("c_custkey", "name")


COUNTRIES = (Country("nation_3", aliases=("asia",)), Country("nation_12"), Country("europe"))
LABELS = {"nation_3": "THREE", "europe": "EUROPE"}


@query("location_groups", """WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 11 = 1 THEN 'Remote' WHEN c_custkey % 11 = 2 THEN 'Bergen, ' || n_name ELSE n_name || ', ' || r_name END AS place, 'https://jobs.example.' || CASE c_custkey % 3 WHEN 0 THEN 'no' WHEN 1 THEN 'FR' ELSE 'com' END || '/x' AS url
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
 g AS (SELECT *, CASE WHEN place = '' THEN 'NO LOCATION' WHEN place LIKE 'Bergen%' THEN 'HOME' WHEN regexp_matches(lower(place), '(^|[^\\p{L}\\p{Nd}])(nation_3|asia)($|[^\\p{L}\\p{Nd}])') THEN 'THREE' WHEN regexp_matches(lower(place), '(^|[^\\p{L}\\p{Nd}])nation_12($|[^\\p{L}\\p{Nd}])') THEN 'NATION_12'
  WHEN regexp_matches(lower(place), '(^|[^\\p{L}\\p{Nd}])europe($|[^\\p{L}\\p{Nd}])') THEN 'EUROPE' WHEN lower(place) LIKE '%remote%' THEN 'REMOTE' ELSE 'OTHER' END AS heading, CASE c_custkey % 3 WHEN 0 THEN 'NORWAY' WHEN 1 THEN 'FRANCE' END AS hint FROM p)
 SELECT c_custkey, heading, hint, CASE WHEN heading IN ('OTHER', 'NO LOCATION') THEN coalesce(hint, heading) ELSE heading END AS shown FROM g""".replace("\\\\", "\\"))
def location_groups(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    place = F.when(k % 11 == 0, "").when(k % 11 == 1, "Remote").when(k % 11 == 2, F.concat(F.lit("Bergen, "), "n_name")).otherwise(F.concat("n_name", F.lit(", "), "r_name"))
    url = F.concat(F.lit("https://jobs.example."), F.when(k % 3 == 0, "no").when(k % 3 == 1, "FR").otherwise("com"), F.lit("/x"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", place.alias("place"), url.alias("url"))
    heading = present.location_group(F.col("place"), ("Bergen", "HOME"), COUNTRIES, LABELS)
    told = rows.select("c_custkey", heading.alias("heading"), present.url_hint(F.col("url"), {"no": "NORWAY", "fr": "FRANCE"}).alias("hint"))
    return told.withColumn("shown", present.group_of(F.col("heading"), F.col("hint")))


@query("title_skills", "SELECT lang AS title, count(DISTINCT source) AS skills FROM documents GROUP BY lang")
def title_skills(spark, sf_dir):
    return discover.skills_per_title(table(spark, sf_dir, "documents").select(F.col("lang").alias("title"), F.col("source").alias("skill")))


@query("barren_skills", "SELECT p_partkey AS skill FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def barren_skills(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("skill"))
    return discover.barren_skills(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("skill")), found)


@query("batch_tally", f"SELECT council, count(*) AS n FROM ({D_COUNCIL}) GROUP BY council")
def batch_tally(spark, sf_dir):
    return council.batch_tally(journal_and_decisions(spark, sf_dir)[0])


@query("portal_verdicts", """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'api_list' WHEN 1 THEN 'api_item' WHEN 2 THEN 'details' ELSE 'card' END AS portal, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 410 WHEN 3 THEN 500 ELSE 200 END AS status,
  contains(html, '<ul>') AND page_id % 5 <> 0 AS has_items, CASE WHEN page_id % 9 = 0 THEN html || ' No longer accepting applications' ELSE html END AS body FROM pages)
 SELECT page_id, CASE portal WHEN 'api_list' THEN status = 200 AND NOT has_items WHEN 'api_item' THEN status IN (403, 404) OR (status = 200 AND NOT has_items) WHEN 'details' THEN status IN (404, 410)
  ELSE status = 404 OR (status = 200 AND contains(lower(body), 'no longer accepting')) END AS dead FROM p""")
def portal_verdicts(spark, sf_dir):
    n = F.col("page_id")
    portal = F.when(n % 4 == 0, "api_list").when(n % 4 == 1, "api_item").when(n % 4 == 2, "details").otherwise("card")
    status = F.when(n % 7 == 0, 404).when(n % 7 == 1, 403).when(n % 7 == 2, 410).when(n % 7 == 3, 500).otherwise(200)
    items = F.contains("html", F.lit("<ul>")) & (n % 5 != 0)
    body = F.when(n % 9 == 0, F.concat("html", F.lit(" No longer accepting applications"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", liveness.portal_dead(portal, status, items, body).alias("dead"))


@query("feed_kinds", """WITH f AS (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'workday' WHEN 1 THEN 'other' END AS explicit, CASE WHEN page_id % 9 = 2 THEN 'https://boards-api.Greenhouse.io/v1/' || page_id END AS api,
  CASE page_id % 9 WHEN 3 THEN regexp_replace(url, '[?].*$', '') || '/sitemap-jobs.xml' WHEN 4 THEN 'https://jobs.ashbyhq.com/team' || page_id WHEN 5 THEN 'https://jobs.lever.co/team' || page_id WHEN 6 THEN 'https://job-boards.eu.greenhouse.io/team' || page_id ELSE url END AS address FROM pages)
 SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'workday' WHEN 2 THEN 'greenhouse' WHEN 3 THEN 'sitemap' WHEN 4 THEN 'ashby' WHEN 5 THEN 'lever' WHEN 6 THEN 'greenhouse' END AS kind,
  address || CASE WHEN contains(address, '?') THEN '&' ELSE '?' END || 'content=true' AS asked FROM f""")
def feed_kinds(spark, sf_dir):
    n = F.col("page_id")
    team = lambda head: F.concat(F.lit(head), n.cast("string"))
    address = (
        F.when(n % 9 == 3, F.concat(F.substring_index("url", "?", 1), F.lit("/sitemap-jobs.xml"))).when(n % 9 == 4, team("https://jobs.ashbyhq.com/team"))
        .when(n % 9 == 5, team("https://jobs.lever.co/team")).when(n % 9 == 6, team("https://job-boards.eu.greenhouse.io/team")).otherwise(F.col("url"))
    )
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.when(n % 9 == 0, "workday").when(n % 9 == 1, "other").alias("explicit"), F.when(n % 9 == 2, team("https://boards-api.Greenhouse.io/v1/")).alias("api"), address.alias("address")
    )
    once = feeds.url_with_content("address")
    return rows.select("page_id", feeds.feed_kind(F.col("explicit"), F.col("api"), F.col("address")).alias("kind"), feeds.url_with_content(once).alias("asked"))


@query("sitemap_slugs", """WITH s AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS path FROM pages)
 SELECT site, count(*) AS n, count(*) FILTER (contains(path, 'a')) AS wanted FROM s GROUP BY site""")
def sitemap_slugs(spark, sf_dir):
    xml = F.concat(F.lit("<urlset>"), F.array_join(F.transform(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1)), lambda p: F.concat(F.lit("<url><loc>https://s.example"), p, F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"), xml.alias("xml"))
    found = feeds.sitemap_urls(pages)
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.replace("url", F.lit("https://s.example"), F.lit("")), F.lit("a"))).alias("wanted"))


@query("window_dates", "SELECT o_orderkey, o_orderdate::DATE - 60 AS since, CASE WHEN o_orderpriority LIKE '%HIGH' OR o_orderpriority LIKE '%URGENT' THEN 2 ELSE 0 END + CASE WHEN o_orderpriority LIKE '%O%' THEN 1 ELSE 0 END AS affinity FROM orders")
def window_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.days_before(F.col("o_orderdate").cast("date"), 60).alias("since"), scalars.affinity(F.col("o_orderpriority"), "(?:HIGH|URGENT)$", "O").alias("affinity")
    )


@query("asked_ids", "SELECT event_id, list_sort(list_distinct([x for x in [event_id, user_id, event_id] if x > 0])) AS ids FROM events")
def asked_ids(spark, sf_dir):
    words = F.array(F.concat(F.lit("#"), F.col("event_id").cast("string")), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.lit("x"), F.lit("-3"))
    return table(spark, sf_dir, "events").select("event_id", F.array_sort(scalars.positive_ids(words)).alias("ids"))


@query("escaped_names", "SELECT page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS attribute, md5(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')) AS back FROM pages")
def escaped_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.escape_attribute("url").alias("attribute"), F.md5(text.unescape_markup(text.escape_html("html"))).alias("back"))
