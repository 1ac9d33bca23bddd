"""Queries of label sets, report tables, links to states, and occupations by taxonomy."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.operators import discover, labels, mail, reports
from quarryline.operators.rules import names_priority
from quarryline.plans.funnel_queries import D_LINKS, D_STATES, D_STORE, link_tables, query, states, stores
from quarryline.session import table

D_OUTCOMES = D_LINKS + """, r AS (SELECT *, row_number() OVER w AS place, max(identity) OVER (PARTITION BY message_id) AS best, first(identity) OVER w - lead(identity) OVER w AS gap FROM l WINDOW w AS (PARTITION BY message_id ORDER BY identity DESC, score DESC, app_id)),
 k AS (SELECT *, bool_or(place = 1 AND coalesce(gap >= 1, true)) OVER (PARTITION BY message_id) AS clear FROM r),
 e AS (SELECT k.app_id, m.kind, m.sent FROM m JOIN k USING (message_id) WHERE (k.clear AND place = 1) OR (NOT k.clear AND m.kind = 'bounced' AND identity = best))"""
LINK_DAY = 1_700_000_000 + 200 * 86_400


D_LINK_STATES = D_OUTCOMES + f""", g AS (SELECT app_id, bool_or(kind = 'bounced') AS b, bool_or(kind = 'acknowledged') AS r, max(sent) AS last_at, count(*) AS n FROM e GROUP BY app_id),
 z AS (SELECT a.app_id AS id, CASE WHEN b AND NOT r THEN 'bounced' WHEN r THEN 'acknowledged' ELSE 'noreply' END AS state, floor(({LINK_DAY} - coalesce(last_at, applied)) / 86400.0) AS silent,
  floor(({LINK_DAY} - applied) / 86400.0)::BIGINT AS days_waiting, coalesce(n, 0) AS n_events FROM a LEFT JOIN g USING (app_id)),
 f AS (SELECT id, CASE WHEN state <> 'bounced' AND silent >= 60 THEN 'ghosted' ELSE state END AS state, days_waiting, n_events FROM z)"""


def states_of_links(spark, sf_dir):
    messages, applications = link_tables(spark, sf_dir)
    outcomes = mail.resolve_links(messages, mail.score_links(messages, applications, noise=(), deciding=True))
    day = F.timestamp_seconds(F.lit(LINK_DAY))
    return mail.application_states(applications.withColumn("longshot", F.lit(False)), mail.link_events(outcomes, messages), day)


@query("link_states", D_LINK_STATES + " SELECT id, state, n_events FROM f")
def link_states(spark, sf_dir):
    return states_of_links(spark, sf_dir).select("id", "state", "n_events")


@query("silence_order", D_LINK_STATES + " SELECT id, state, days_waiting, row_number() OVER (ORDER BY coalesce(days_waiting, -1) DESC, id) AS place FROM f WHERE state IN ('noreply', 'ghosted')")
def silence_order(spark, sf_dir):
    return reports.silence_first(states_of_links(spark, sf_dir)).select("id", "state", "days_waiting", "place")


@query("state_cover", D_STATES + " SELECT count(*) AS applications, count(*) FILTER (state IN ('bounced', 'ghosted', 'interview', 'rejected', 'acknowledged', 'noreply')) AS counted, applications = counted AS complete FROM f")
def state_cover(spark, sf_dir):
    return reports.state_cover(states(spark, sf_dir))


@query("newest_gaps", "SELECT event_id, user_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 8")
def newest_gaps(spark, sf_dir):
    return reports.newest_of(table(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "user_id"), "event_id")


@query("recurrence_notes", D_STORE + """, t AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, title, key) AS place, count(*) OVER (PARTITION BY bucket) AS every_one FROM k WHERE n >= 2),
 c AS (SELECT *, sum(length(title) + 9) OVER (ORDER BY CASE bucket WHEN 'no-field' THEN 0 ELSE 1 END, place) AS used FROM t WHERE place <= CASE bucket WHEN 'no-field' THEN 12 ELSE 6 END),
 n AS (SELECT b AS bucket, (SELECT count(*) FROM c WHERE bucket = b AND used <= 2000) AS shown, (SELECT coalesce(max(every_one), 0) FROM t WHERE bucket = b) AS every FROM (VALUES ('no-field'), ('rule'), ('none')) v(b))
 SELECT *, CASE WHEN every = 0 THEN 'nothing has recurred yet' WHEN shown = 0 THEN 'to show, but the message is full' WHEN every > shown THEN 'showing the top' ELSE '' END AS note FROM n""")
def recurrence_notes(spark, sf_dir):
    store = discover.merge_drops(*stores(spark, sf_dir), F.lit("2024-03-25").cast("date"))
    return reports.recurrence_notes(store, {"no-field": 12, "rule": 6, "none": 3}, F.length("title") + 9, 2000)


@query("fresh_labels", """WITH l AS (SELECT p_name || ' ' || p_partkey // 3 AS label, p_size FROM part) SELECT DISTINCT label FROM l WHERE lower(label) NOT IN (SELECT lower(label) FROM l WHERE p_size > 40 UNION SELECT lower(label) FROM l WHERE p_size < 5)""")
def fresh_labels(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.expr("p_partkey DIV 3").cast("string")).alias("label"), "p_size")
    known, accepted = part.filter("p_size > 40").select(F.upper("label").alias("known")), part.filter("p_size < 5").select("label")
    return labels.without(part.select("label").distinct(), "label", known, accepted)


@query("distinct_labels", """SELECT arg_min(label, place) AS label FROM (SELECT DISTINCT r_name AS label, 0 AS place FROM region UNION ALL SELECT DISTINCT n_name, 1 FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 2 FROM customer UNION ALL SELECT DISTINCT lower(n_name), 3 FROM nation) GROUP BY lower(label)""")
def distinct_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return labels.together(table(spark, sf_dir, "region").select("r_name"), n.select("n_name"), table(spark, sf_dir, "customer").select("c_mktsegment"), n.select(F.lower("n_name").alias("low")))


@query("gone_ids", "SELECT o_custkey AS id FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def gone_ids(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    return labels.without(old, "id", table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey"), folded=False)


@query("occupation_taxonomy", """WITH s AS (SELECT p_name AS term, p_partkey AS skill, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS place FROM part),
 h AS (SELECT term, l_suppkey AS uri, arg_min(l_returnflag = 'R', place * 1000000000000 + l_orderkey * 10 + l_linenumber) AS essential FROM s JOIN lineitem ON l_partkey = skill WHERE place <= 2 GROUP BY ALL)
 SELECT uri, sum(CASE WHEN essential THEN 2 ELSE 1 END)::BIGINT AS score, count(*) AS terms FROM h GROUP BY uri""")
def occupation_taxonomy(spark, sf_dir):
    skills = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("skill"), F.col("p_partkey").alias("rank"))
    relations = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("skill"), F.col("l_suppkey").alias("uri"), F.lit("").alias("title"),
        (F.col("l_returnflag") == "R").alias("essential"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nth"),
    )
    return discover.score_occupations(discover.occupation_hits(skills, relations)).select("uri", "score", "terms")


@query("priority_titles", r"""SELECT doc_id, regexp_matches(lower(strip_accents(coalesce(source, '') || ' ' || coalesce(text, ''))), '(^|[^\p{L}\p{Nd}])(stone|und|que)($|[^\p{L}\p{Nd}])') AS priority FROM documents""")
def priority_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", names_priority("source", "text", ("Stone", "und", "QUE")).alias("priority"))
