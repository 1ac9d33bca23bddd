"""Queries of admission, dedup, the ledger, mail, council, discovery and presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions import phrases, text
from quarryline.functions.patterns import Rule
from quarryline.operators import admission, council, dedup, discover, ledger, mail, present
from quarryline.operators.rules import Country, CountryRules, LocationRules, TitleRules
from quarryline.plans import fixtures as fx
from quarryline.plans.text_queries import D_TITLE, D_URL, d_html, d_role, with_rows
from quarryline.session import table
from quarryline.streaming import twins

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


GATES = admission.Gates(
    titles=TitleRules(positive=(), negative=(Rule("und"), Rule("queue", ("pour",)), Rule("anle"))),
    locations=LocationRules(allow=("en", "fr", "de", "es"), block=("es",)),
    countries=CountryRules((Country("fr", "off"),)),
    companies=("spam-farm",),
)


def page_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as offers: every page, and again with a changed address and the same role."""
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"), "url", text.html_title("html").alias("title"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("company"), F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1).alias("location"),
    )
    again = pages.withColumns({"seq": F.col("seq") + 1_000_000_000, "url": F.concat("url", F.when(F.col("seq") % 2 == 0, "?ref=again").otherwise("&ref=again"))})
    return pages.unionByName(again)


D_OFFERS = f"""offers AS (SELECT page_id AS seq, url, {d_html(D_TITLE)} AS title,
 regexp_extract(url, '^https?://([^/]+)', 1) AS company, regexp_extract(url, '^https?://[^/]+/([a-z]{{2}})/', 1) AS location FROM pages),
o2 AS (SELECT * FROM offers UNION ALL SELECT seq + 1000000000, url || CASE WHEN seq % 2 = 0 THEN '?ref=again' ELSE '&ref=again' END, title, company, location FROM offers),
keyed AS (SELECT *, {D_URL} AS url_key, {d_role('company')} || '::' || {d_role('title')} AS role_key FROM o2)"""
# the greedy walk itself, one row at a time
D_WALK = """ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM {rows}),
walk(i, urls, roles, kept) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
 UNION ALL SELECT r.i, CASE WHEN k THEN list_append(urls, r.url_key) ELSE urls END, CASE WHEN k THEN list_append(roles, r.role_key) ELSE roles END, CASE WHEN k THEN list_append(kept, r.seq) ELSE kept END
 FROM (SELECT w.*, r.*, NOT list_contains(w.urls, r.url_key) AND NOT list_contains(w.roles, r.role_key) AS k FROM walk w JOIN ranked r ON r.i = w.i + 1) t(wi, urls, roles, kept, {names}, i, k), LATERAL (SELECT t.i, t.url_key, t.role_key, t.seq) r)"""


def d_walk(rows: str, order: str, names: str) -> str:
    return D_WALK.format(rows=rows, order=order, names=names)


D_NAMES = "seq, url, title, company, location, url_key, role_key"
D_GATED = r"""gated AS (SELECT *, CASE WHEN regexp_matches(company, '\bspam-farm\b') THEN 'COMPANY' WHEN regexp_matches(t, '\b(und|anle)(s|es|en|in|innen)?\b') THEN 'TITLE'
  WHEN location <> '' AND (location = 'es' OR location NOT IN ('en', 'fr', 'de')) THEN 'LOCATION' WHEN regexp_matches(t, '\bes\b') THEN 'LOCATION' WHEN location = 'fr' THEN 'COUNTRY' END AS gate
 FROM (SELECT *, lower(strip_accents(title)) AS t FROM keyed))"""
D_STAGED = f"""WITH RECURSIVE {D_OFFERS}, {D_GATED}, free AS (SELECT {D_NAMES} FROM gated WHERE gate IS NULL), {d_walk('free', 'seq', D_NAMES)},
final AS (SELECT list_distinct(kept) AS kept FROM walk ORDER BY i DESC LIMIT 1),
staged AS (SELECT g.seq, coalesce(gate, CASE WHEN list_contains(final.kept, g.seq) THEN 'ADMITTED' ELSE 'DUPLICATE' END) AS stage FROM gated g, final)"""


@query("admission_stages", D_STAGED + " SELECT seq, stage FROM staged")
def admission_stages(spark, sf_dir):
    return admission.admit(page_offers(spark, sf_dir), GATES).select("seq", "stage")


@query("funnel_counts", D_STAGED + """ SELECT p.place, p.stage, count(s.seq) AS n FROM (VALUES (0, 'NO LINK'), (1, 'COMPANY'), (2, 'TITLE'), (3, 'LOCATION'), (4, 'COUNTRY'), (5, 'DUPLICATE'), (6, 'ADMITTED')) p(place, stage)
 LEFT JOIN staged s USING (stage) GROUP BY ALL""")
def funnel_counts(spark, sf_dir):
    return admission.funnel_counts(admission.admit(page_offers(spark, sf_dir), GATES))


def keyed_offers(spark, sf_dir):
    return page_offers(spark, sf_dir).select("seq", text.url_key("url").alias("url_key"), text.role_key("company", "title").alias("role_key"))


@query("dedup_first", f"WITH RECURSIVE {D_OFFERS}, {d_walk('keyed', 'seq', D_NAMES)} SELECT unnest(kept) AS seq FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)")
def dedup_first(spark, sf_dir):
    return dedup.greedy_two_key(keyed_offers(spark, sf_dir), "url_key", "role_key", "seq").select("seq")


@query("dedup_newest", f"WITH RECURSIVE {D_OFFERS}, {d_walk('keyed', 'seq DESC', D_NAMES)} SELECT unnest(kept) AS seq FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)")
def dedup_newest(spark, sf_dir):
    return dedup.greedy_two_key(keyed_offers(spark, sf_dir), "url_key", "role_key", "seq", newest=True).select("seq")


@query("last_wins", """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, min(event_id) AS first_seq FROM events GROUP BY user_id""")
def last_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return dedup.last_wins(rows, "user_id", "event_id")


@query("history_anti", f"SELECT page_id FROM pages WHERE {D_URL} NOT IN (SELECT {D_URL} FROM pages WHERE page_id % 3 = 0)")
def history_anti(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", text.url_key("url").alias("url_key"))
    return ledger.unknown_only(pages, pages.filter("page_id % 3 = 0"), "url_key").select("page_id")


@query("null_key_exempt", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR (CASE WHEN o_orderstatus <> 'P' THEN o_custkey END) NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def null_key_exempt(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("c_custkey"))
    known = table(spark, sf_dir, "customer").filter("c_mktsegment = 'MACHINERY'").select("c_custkey")
    return ledger.unknown_only(orders, known, "c_custkey").select("o_orderkey")


@query("assigned_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(c_custkey) FROM customer) AS id FROM orders")
def assigned_ids(spark, sf_dir):
    hwm = ledger.high_water(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    return ledger.assign_ids(rows, "o_orderkey", hwm)


@query("outage_brakes", "SELECT day, pending, dead, (dead >= 5 AND dead >= ceil(pending / 2)) OR (dead = pending AND dead >= 3) AS brake FROM (SELECT ts::DATE AS day, user_id % 7 AS g, count(*) AS pending, count(*) FILTER (event_type IN ('error', 'view', 'click')) AS dead FROM events GROUP BY ALL)")
def outage_brakes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 7).alias("g")).agg(
        F.count(F.lit(1)).alias("pending"), F.count_if(F.col("event_type").isin("error", "view", "click")).alias("dead")
    )
    return rows.select("day", "pending", "dead", ledger.outage(F.col("pending"), F.col("dead")).alias("brake"))


def d_phrase(pattern: str) -> str:
    """A phrase list as a DuckDB string; its engine has no look-behind, so courses \"under way\" are cut out of the text instead."""
    return "'" + pattern.replace(r"(?<!\ben )", "").replace("'", "''") + "'"


def d_outright(pattern: str) -> str:
    p = d_phrase(pattern)
    before = d_phrase(f"^(.*?)(?:{pattern})")
    return f"len(list_filter(regexp_split_to_array(t, '[.!?;·•]+'), lambda s: regexp_matches(s, {p}) AND NOT regexp_matches(regexp_extract(s, {before}, 1), {d_phrase(phrases.CONDITIONAL)}))) > 0"


@query("mail_kinds", with_rows(fx.MAILS, rf"""SELECT id, CASE WHEN trim(t) = '' THEN NULL WHEN regexp_matches(t, {d_phrase(phrases.BOUNCED)}) THEN 'bounced' WHEN regexp_matches(o, {d_phrase(phrases.ALERT_DECLARED)}) THEN 'alert'
 WHEN {d_outright(phrases.REJECTED)} THEN 'rejected' WHEN {d_outright(phrases.INTERVIEW)} AND NOT regexp_matches(regexp_replace(o, '\ben cursos?\b', '', 'g'), {d_phrase(phrases.ADVICE)}) THEN 'interview'
 WHEN regexp_matches(t, {d_phrase(phrases.ACKNOWLEDGED)}) THEN 'acknowledged' WHEN regexp_matches(t, {d_phrase(phrases.ALERT)}) THEN 'alert' END AS kind,
 regexp_matches(coalesce(lower(sender), ''), {d_phrase(phrases.AUTOMATED)}) AS automated
 FROM (SELECT *, lower(strip_accents(coalesce(subject, '') || ' ' || coalesce(snippet, '') || ' ' || coalesce(body, ''))) AS t, lower(strip_accents(coalesce(subject, '') || ' ' || coalesce(snippet, ''))) AS o FROM mails)"""))
def mail_kinds(spark, sf_dir):
    c = F.col
    return fx.MAILS.frame(spark, sf_dir).select("id", mail.message_kind(c("subject"), c("snippet"), c("body")).alias("kind"), mail.looks_automated(c("sender")).alias("automated"))


def link_tables(spark, sf_dir):
    """Turns as messages, and conversations as applications named after words of their first turn."""
    turns = table(spark, sf_dir, "conversations")
    messages = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("").alias("subject"), F.lit("").alias("snippet"), F.col("text").alias("body"),
        F.lit("").alias("from"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86_400).alias("date"),
        F.when(F.col("role") == "user", "acknowledged").otherwise("bounced").alias("kind"),
    )
    words = F.filter(F.split(text.fold("text"), "[^a-z0-9]+"), lambda w: F.length(w) > 3)
    named = turns.filter("turn = 0").select("conv_id", words.alias("w"))
    word = lambda i: F.get("w", F.lit(i))
    applications = named.select(
        F.col("conv_id").alias("id"), word(0).alias("company"), F.concat_ws(" ", word(1), word(2)).alias("title"),
        word(4).alias("location"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 86_000).alias("ts"),
    )
    return messages, applications


D_LINKS = r"""WITH t AS (SELECT conv_id, turn, role, text, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^a-z0-9]+'), lambda w: length(w) > 3) AS w FROM conversations),
m AS (SELECT conv_id * 1000 + turn AS message_id, CASE WHEN role = 'user' THEN 'acknowledged' ELSE 'bounced' END AS kind, list_filter(regexp_split_to_array(lower(strip_accents(text)), '[^\p{L}\p{Nd}]+'), lambda x: x <> '') AS words,
  regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g') AS squeezed, 1700000000 + conv_id * 86400 AS sent FROM t),
a AS (SELECT conv_id AS app_id, coalesce(w[1], '') AS company, coalesce(w[2], '') AS t1, coalesce(w[3], '') AS t2, coalesce(w[5], '') AS city, 1700000000 + conv_id * 86000 AS applied FROM t WHERE turn = 0),
s AS (SELECT message_id, kind, app_id, CASE WHEN list_contains(words, company) OR (length(company) >= 6 AND contains(squeezed, company)) THEN 10 ELSE 0 END AS c,
  list_contains(words, t1)::INT + list_contains(words, t2)::INT AS h, (sent - applied) / 86400.0 AS days, list_contains(words, city) AS city FROM m, a),
i AS (SELECT *, c + CASE WHEN h >= 2 THEN 3 WHEN h = 1 AND c > 0 THEN 1 ELSE 0 END AS identity FROM s),
l AS (SELECT message_id, kind, app_id, identity::INT AS identity, (identity + CASE WHEN days <= 1 THEN 3 WHEN days <= 5 THEN 2 WHEN days <= 30 THEN 1 ELSE 0 END + city::INT)::INT AS score FROM i WHERE identity > 0 AND days >= -2)"""


@query("link_scores", D_LINKS + " SELECT message_id, app_id, identity, score FROM l")
def link_scores(spark, sf_dir):
    return mail.score_links(*link_tables(spark, sf_dir), noise=()).select("message_id", "app_id", "identity", "score")


@query("link_outcomes", D_LINKS + """, r AS (SELECT *, row_number() OVER w AS place, max(identity) OVER (PARTITION BY message_id) AS best, first(identity) OVER w - lead(identity) OVER w AS gap FROM l WINDOW w AS (PARTITION BY message_id ORDER BY identity DESC, score DESC, app_id)),
 k AS (SELECT *, bool_or(place = 1 AND coalesce(gap >= 1, true)) OVER (PARTITION BY message_id) AS clear FROM r)
 SELECT m.message_id, k.app_id, m.kind, CASE WHEN k.app_id IS NULL THEN 'orphan' WHEN k.clear OR m.kind = 'bounced' THEN 'link' ELSE 'tie' END AS outcome, k.score
 FROM m LEFT JOIN (SELECT * FROM k WHERE (clear AND place = 1) OR (NOT clear AND identity = best)) k USING (message_id)""")
def link_outcomes(spark, sf_dir):
    messages, applications = link_tables(spark, sf_dir)
    return mail.resolve_links(messages, mail.score_links(messages, applications, noise=(), deciding=True))


TODAY = "2024-03-10 00:00:00"
KINDS = {"signup": "acknowledged", "purchase": "interview", "error": "rejected", "view": "bounced"}


def app_tables(spark, sf_dir):
    """Users as applications, and their events of the kinds that a message can be as messages."""
    events = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
    linked = events.select(F.col("user_id").alias("app_id"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("at")).filter("kind IS NOT NULL")
    apps = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").cast("timestamp").alias("ts"))
    return apps.withColumn("longshot", F.col("id") % 5 == 0), linked


D_STATES = f"""WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'signup' THEN 'acknowledged' WHEN 'purchase' THEN 'interview' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'bounced' END AS kind FROM events),
a AS (SELECT user_id AS id, min(ts) AS ts FROM events GROUP BY user_id),
g AS (SELECT user_id, bool_or(kind = 'bounced') AS b, bool_or(kind <> 'bounced') AS r, bool_or(kind = 'rejected') AS x, bool_or(kind = 'interview') AS i, max(ts) AS last_at, count(*) AS n FROM e WHERE kind IS NOT NULL GROUP BY user_id),
s AS (SELECT id, CASE WHEN b AND NOT r THEN 'bounced' WHEN x THEN 'rejected' WHEN i THEN 'interview' WHEN r THEN 'acknowledged' ELSE 'noreply' END AS state, floor((epoch_ms(TIMESTAMP '{TODAY}') - epoch_ms(coalesce(last_at, ts))) / 86400000.0) AS silent,
  floor((epoch_ms(TIMESTAMP '{TODAY}') - epoch_ms(ts)) / 86400000.0)::BIGINT AS days_waiting, coalesce(n, 0) AS n_events FROM a LEFT JOIN g ON id = user_id),
f AS (SELECT id, CASE WHEN state IN ('noreply', 'acknowledged') AND silent >= 60 THEN 'ghosted' ELSE state END AS state, days_waiting, n_events, id % 5 = 0 AS longshot FROM s)"""


def states(spark, sf_dir):
    return mail.application_states(*app_tables(spark, sf_dir), F.lit(TODAY).cast("timestamp"))


@query("application_states", D_STATES + " SELECT * FROM f")
def application_states(spark, sf_dir):
    return states(spark, sf_dir)


@query("application_tallies", D_STATES + " SELECT count(*) AS applications, count(*) FILTER (longshot) AS longshots, " + ", ".join(
    f"count(*) FILTER (state = '{s}') AS {s}_all, count(*) FILTER (state = '{s}' AND NOT longshot) AS {s}_real" for s in mail.STATES) + ", count(*) FILTER (n_events > 0) AS answered FROM f")
def application_tallies(spark, sf_dir):
    return mail.tallies(states(spark, sf_dir))


@query("verdict_overlay", D_STATES + """, v AS (SELECT user_id, arg_max(event_type, event_id) AS st FROM events WHERE event_type = 'click' GROUP BY user_id)
 SELECT id, coalesce(st, state) AS state, st IS NOT NULL AS decided_by_user FROM f LEFT JOIN v ON id = user_id""")
def verdict_overlay(spark, sf_dir):
    # clicks are no messages: they stand for what a user decides
    verdicts = table(spark, sf_dir, "events").filter("event_type = 'click'").select(
        F.col("user_id").alias("id"), F.col("event_type").alias("state"), F.lit("").alias("reason"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq")
    )
    return mail.overlay_verdicts(states(spark, sf_dir), verdicts).select("id", "state", "decided_by_user")


D_VOTES = "(SELECT doc_id, quality, toxic, CASE WHEN quality = 1 THEN 'show' ELSE 'hide' END AS a, CASE WHEN toxic = 1 THEN 'hide' WHEN doc_id % 3 = 0 THEN NULL ELSE 'show' END AS b, CASE WHEN doc_id % 2 = 0 THEN 'show' ELSE 'hide' END AS c FROM labels)"


def votes(spark, sf_dir):
    q, t, d = F.col("quality"), F.col("toxic"), F.col("doc_id")
    ballots = F.array(
        F.when(q == 1, "show").otherwise("hide"), F.when(t == 1, "hide").when(d % 3 == 0, F.lit(None)).otherwise("show"), F.when(d % 2 == 0, "show").otherwise("hide")
    )
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", council.majority(ballots).alias("council"))


D_COUNCIL = f"SELECT doc_id, quality, toxic, CASE WHEN (a = 'show')::INT + coalesce((b = 'show')::INT, 0) + (c = 'show')::INT >= 2 THEN 'show' WHEN (a = 'hide')::INT + coalesce((b = 'hide')::INT, 0) + (c = 'hide')::INT >= 2 THEN 'hide' ELSE 'tie' END AS council FROM {D_VOTES}"


@query("council_votes", D_COUNCIL)
def council_votes(spark, sf_dir):
    return votes(spark, sf_dir)


def journal_and_decisions(spark, sf_dir):
    journal = votes(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "council", F.lit(None).cast("string").alias("user_decision"), F.col("doc_id").alias("seq")
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"), "lang")
    applied = docs.filter("lang = 'en' AND id % 2 = 0").withColumn("longshot", F.col("id") % 8 == 0)
    feedback = docs.filter("lang = 'de' OR id % 10 = 0").withColumn("url", F.when(F.col("id") % 4 == 0, F.lit(None)).otherwise(F.col("url")))
    pending = docs.filter("lang = 'fr'").withColumn("by_user", F.lit(True))
    return journal, council.user_decisions(applied, feedback, pending)


D_RECONCILED = f"""SELECT j.doc_id AS id, j.council, CASE WHEN lang = 'en' AND doc_id % 2 = 0 AND doc_id % 8 <> 0 THEN 'show' WHEN (lang = 'de' OR doc_id % 10 = 0) AND doc_id % 4 <> 0 THEN 'hide'
 WHEN lang = 'fr' THEN 'seen' WHEN lang = 'de' OR doc_id % 10 = 0 THEN 'hide' END AS user_decision FROM ({D_COUNCIL}) j LEFT JOIN documents USING (doc_id)"""


@query("reconciled", D_RECONCILED)
def reconciled(spark, sf_dir):
    return council.reconcile(*journal_and_decisions(spark, sf_dir)).select("id", "council", "user_decision")


@query("agreement", f"SELECT user_decision, council, count(*) AS n, user_decision = council AS agrees FROM ({D_RECONCILED}) WHERE user_decision IN ('show', 'hide') AND council IN ('show', 'hide') GROUP BY ALL")
def agreement(spark, sf_dir):
    return council.agreement(council.reconcile(*journal_and_decisions(spark, sf_dir)))


@query("council_tags", f"SELECT d.doc_id AS id, council FROM documents d LEFT JOIN ({D_COUNCIL}) USING (doc_id)")
def council_tags(spark, sf_dir):
    journal, _ = journal_and_decisions(spark, sf_dir)
    offers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    return council.council_tags(offers, journal).select("id", "council")


@query("unjudged", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unjudged(spark, sf_dir):
    journal, _ = journal_and_decisions(spark, sf_dir)
    named = lambda rows: rows.withColumns({"company": F.lit(""), "title": F.lit("")})
    offers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))
    return council.unjudged(named(offers), named(journal)).select("id")


def stores(spark, sf_dir):
    """A recurrence store from the first half of the events, and drops from the second."""
    events = table(spark, sf_dir, "events")
    title = F.concat(F.initcap("event_type"), F.lit("  user "), F.col("user_id").cast("string"))
    old = events.filter("event_id % 2 = 0").groupBy(discover.title_key(title).alias("key")).agg(
        F.min(title).alias("title"), F.lit("old").alias("why"), F.lit("rule").alias("bucket"), F.count(F.lit(1)).alias("n"),
        F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"),
    )
    drops = events.filter("event_id % 2 = 1").select(
        title.alias("title"), F.concat(F.lit("reason "), F.col("event_id").cast("string")).alias("why"),
        F.when(F.col("value") > 5, "no-field").otherwise("rule").alias("bucket"), F.col("event_id").alias("seq"),
    )
    return old, drops


D_STORE = """WITH e AS (SELECT *, upper(event_type[1]) || event_type[2:] || '  user ' || user_id AS title, lower(event_type || ' user ' || user_id) AS key FROM events),
o AS (SELECT key, -1 AS seq, min(title) AS title, 'old' AS why, 'rule' AS bucket, count(*) AS n, min(ts)::DATE AS first, max(ts)::DATE AS last FROM e WHERE event_id % 2 = 0 GROUP BY key),
d AS (SELECT key, event_id, title, 'reason ' || event_id, CASE WHEN value > 5 THEN 'no-field' ELSE 'rule' END, 1, DATE '2024-03-25', DATE '2024-03-25' FROM e WHERE event_id % 2 = 1),
m AS (SELECT key, arg_min(title, seq) AS title, arg_max(why, seq) AS why, arg_max(bucket, seq) AS bucket, sum(n)::BIGINT AS n, arg_min(first, seq) AS first, arg_max(last, seq) AS last FROM (FROM o UNION ALL FROM d) GROUP BY key),
k AS (SELECT * FROM m WHERE last >= DATE '2024-01-25' ORDER BY n DESC, last DESC, key LIMIT 20000)"""


@query("recurrence_store", D_STORE + " SELECT * FROM k")
def recurrence_store(spark, sf_dir):
    return discover.merge_drops(*stores(spark, sf_dir), F.lit("2024-03-25").cast("date"))


@query("top_recurring", D_STORE + " SELECT key, n FROM k WHERE bucket = 'no-field' AND n >= 2 ORDER BY n DESC, title, key LIMIT 12")
def top_recurring(spark, sf_dir):
    return discover.top_recurring(discover.merge_drops(*stores(spark, sf_dir), F.lit("2024-03-25").cast("date"))).select("key", "n")


@query("candidate_terms", """WITH w AS (SELECT p_name AS t, string_split(p_name, ' ') AS w FROM part),
 x AS (SELECT t, unnest(list_concat(list_filter(w, lambda x: length(x) >= 3), CASE WHEN len(list_filter(w, lambda x: length(x) >= 3)) > 1 THEN [w[1] || ' ' || w[2]] ELSE [] END)) AS term FROM w)
 SELECT term, count(*) AS n, count(DISTINCT t) AS titles FROM x WHERE term NOT IN ('anvil', 'red') GROUP BY term""")
def candidate_terms(spark, sf_dir):
    known = spark.createDataFrame([("Anvil",), ("red",)], "term string")
    return discover.candidate_terms(table(spark, sf_dir, "part"), "p_name", known)


@query("occupation_scores", """SELECT l_suppkey AS uri, sum(CASE WHEN essential THEN 2 ELSE 1 END)::BIGINT AS score, count(*) AS terms
 FROM (SELECT l_suppkey, l_partkey, arg_min(l_returnflag = 'R', l_orderkey * 10 + l_linenumber) AS essential FROM lineitem GROUP BY ALL) GROUP BY l_suppkey""")
def occupation_scores(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("uri"), F.col("l_partkey").alias("term"), (F.col("l_returnflag") == "R").alias("essential"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.lit("").alias("title"),
    )
    return discover.score_occupations(hits).select("uri", "score", "terms")


TERMS = ["ring", "bolt", "gizmo", "hot", "zinc"]


@query("term_records", """SELECT term, (SELECT count(*) FROM part WHERE contains(p_name, term) AND p_partkey % 3 = 0 AND p_size > 20) AS rejected, (SELECT count(*) FROM part WHERE contains(p_name, term) AND p_partkey % 3 = 0 AND p_size <= 20) AS already_fixed,
 (SELECT count(*) FROM part WHERE contains(p_name, term) AND p_partkey % 3 > 0 AND p_size > 10) AS applied, (SELECT count(*) FROM part WHERE contains(p_name, term) AND p_partkey % 3 > 0 AND p_size <= 10) AS longshots
 FROM (VALUES ('ring'), ('bolt'), ('gizmo'), ('hot'), ('zinc')) t(term)""")
def term_records(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), "p_partkey", "p_size")
    applied = part.filter("p_partkey % 3 > 0").withColumn("longshot", F.col("p_size") <= 10)
    return discover.term_records(TERMS, part.filter("p_partkey % 3 = 0"), applied, F.col("p_size") > 20)


@query("reason_families", with_rows(fx.REASONS, r"""SELECT id, CASE WHEN trim(t) IN ('', '(no reason)') THEN 'unstated'
 WHEN regexp_matches(t, '(^|[^a-z0-9_])closed($|[^a-z0-9_])|expired|no longer|(dead|broken) link|duplicate|duplicad|reflotad|cerrad|no va el link|no acepta') THEN 'noise'
 WHEN regexp_matches(t, 'not (my|the right) (area|field|job|role)|nothing to do with|wrong (field|role|sector)|(dont|don''t) want to be|not interested in the role|no es trabajo para mi|no es un trabajo para mi|no tiene nada que ver|no me interesa|no quiero ser|no me gusta el puesto') THEN 'field'
 WHEN regexp_matches(t, 'experienc|expertise|years|jahre|jaar|(^|[^a-z0-9_])(anos|ans)($|[^a-z0-9_])|requirement|requisito|mandatory|skills|conocimiento|nivel|dominio|master|degree|grado|titulacion|carrera|licenc|estudios|language|idioma|fluent|german|aleman|dutch|holand|neerland|frances') THEN 'requirements'
 ELSE 'other' END AS family FROM (SELECT id, lower(strip_accents(coalesce(reason, ''))) AS t FROM reasons)"""))
def reason_families(spark, sf_dir):
    return fx.REASONS.frame(spark, sf_dir).select("id", discover.reason_family(F.col("reason")).alias("family"))


@query("stem_families", "SELECT term, rejected FROM (SELECT p_name AS term, count(*) AS rejected, row_number() OVER (PARTITION BY left(p_name, 8) ORDER BY count(*) DESC, p_name) AS place FROM part GROUP BY p_name) WHERE place = 1")
def stem_families(spark, sf_dir):
    return discover.stem_families(table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("term")).agg(F.count(F.lit(1)).alias("rejected")))


@query("cv_skills", with_rows(fx.CV, r"""SELECT cv_id, skill, min(line_no)::INT AS line_no FROM (
 SELECT cv_id, line_no, trim(regexp_replace(piece, '[()]', '', 'g')) AS skill FROM (
  SELECT cv_id, line_no, unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(line, '^[-*]\s*', ''), '\([^()]*\)', '', 'g'), '\*\*', '', 'g'), '[,/;]')) AS piece FROM (
   SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY cv_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS inside FROM (
    SELECT *, length(regexp_extract(line, '^(#{1,6})\s', 1)) AS level, CASE WHEN level BETWEEN 1 AND 2 THEN regexp_matches(lower(line), 'skill|competenc|aptitud') END AS opens FROM cv))
  WHERE inside AND level = 0))
 WHERE length(skill) BETWEEN 3 AND 34 AND len(regexp_split_to_array(skill, '\s+')) <= 4 AND regexp_matches(lower(skill), '[a-z]{3}')
  AND NOT regexp_matches(skill, '^\d') AND NOT regexp_matches(lower(skill), '^(?:native|[abc][12]|spanish|english|dutch|german|french)(?:[^a-z]|$)') GROUP BY cv_id, skill"""))
def cv_skills(spark, sf_dir):
    return discover.cv_skills(fx.CV.frame(spark, sf_dir))


ORDER = ("ASIA", "EUROPE", "AMERICA")


@query("group_order", """SELECT c_custkey, row_number() OVER (ORDER BY CASE r_name WHEN 'ASIA' THEN 1 WHEN 'EUROPE' THEN 2 WHEN 'AMERICA' THEN 3 ELSE 4 END, aff DESC, c_custkey) AS place FROM (
 SELECT c_custkey, r_name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS aff FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)""")
def group_order(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    affinity = F.when(F.col("c_mktsegment") == "MACHINERY", 2).otherwise(0) + F.when(F.col("c_acctbal") < 0, 1).otherwise(0)
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "r_name", affinity.alias("affinity"))
    return present.group_order(rows, "r_name", "affinity", "c_custkey", ORDER).select("c_custkey", "place")


@query("packed_pages", """WITH RECURSIVE i AS (SELECT o_custkey, o_orderkey, length(o_orderpriority) * 10 AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
 p(o_custkey, o_orderkey, k, page, used) AS (SELECT o_custkey, o_orderkey, k, 1, size FROM i WHERE k = 1
  UNION ALL SELECT i.o_custkey, i.o_orderkey, i.k, CASE WHEN p.used + size <= 200 THEN page ELSE page + 1 END, CASE WHEN p.used + size <= 200 THEN p.used + size ELSE size END FROM p JOIN i ON i.o_custkey = p.o_custkey AND i.k = p.k + 1)
 SELECT o_custkey, o_orderkey, page FROM p""")
def packed_pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.length("o_orderpriority") * 10).alias("size"))
    return present.pack_rows(orders, "o_custkey", ("o_orderkey",), "size", 200).select("o_custkey", "o_orderkey", "page")


@query("grouped_pages", """WITH RECURSIVE i AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, length(o_orderpriority) * 10 AS size, length(o_orderpriority) % 4 * 5 + 9 AS head FROM orders),
 k AS (SELECT *, row_number() OVER w AS k, coalesce(lag(s) OVER w <> s, true) AS opens FROM i WINDOW w AS (PARTITION BY o_custkey ORDER BY s, o_orderkey)),
 h AS (SELECT *, first(head) OVER (PARTITION BY o_custkey, s ORDER BY o_orderkey) AS heading FROM k),
 p(o_custkey, o_orderkey, k, page, used) AS (SELECT DISTINCT o_custkey, 0::BIGINT, 0::BIGINT, 1, 0::BIGINT FROM h
  UNION ALL SELECT o_custkey, o_orderkey, k, CASE WHEN u2 > 0 AND u2 + size > 200 THEN p2 + 1 ELSE p2 END, CASE WHEN u2 > 0 AND u2 + size > 200 THEN heading + size ELSE u2 + size END FROM (
   SELECT *, CASE WHEN turns THEN page + 1 ELSE page END AS p2, CASE WHEN turns THEN heading WHEN opens THEN used + heading ELSE used END AS u2 FROM (
    SELECT h.*, p.page, p.used, h.opens AND p.used > 0 AND p.used + h.heading + 3 > 200 AS turns FROM p JOIN h ON h.o_custkey = p.o_custkey AND h.k = p.k + 1)))
 SELECT o_custkey, o_orderkey, page FROM p WHERE k > 0""")
def grouped_pages(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", (F.length("o_orderpriority") * 10).alias("size"), (F.length("o_orderpriority") % 4 * 5 + 9).alias("head"))
    headings = orders.groupBy("o_custkey", "o_orderstatus").agg(F.min_by("head", "o_orderkey").alias("heading"))
    rows = orders.drop("head").join(headings, ["o_custkey", "o_orderstatus"])
    packed = present.pack_groups(rows, "o_custkey", "o_orderstatus", ("o_orderstatus", "o_orderkey"), "size", F.col("heading"), 200)
    return packed.select("o_custkey", "o_orderkey", "page")


@query("budget_prefix", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, sum(length(o_orderpriority)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS used FROM orders) WHERE used <= 40")
def budget_prefix(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("size", F.length("o_orderpriority"))
    return present.within_budget(rows, "size", 40, ("o_orderkey",), by=("o_custkey",)).select("o_custkey", "o_orderkey")


@query("source_caps", "SELECT doc_id, place, source_offers FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS source_offers FROM documents) WHERE place <= 3000")
def source_caps(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return admission.cap_per_source(rows, "source", "doc_id").select("doc_id", "place", "source_offers")


@query("cadence_gates", """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
 g(user_id, k, prev, n) AS (SELECT user_id, k, t, 1 FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, CASE WHEN t - prev >= 86400000 THEN t ELSE prev END, n + (t - prev >= 86400000)::INT FROM g JOIN e ON e.user_id = g.user_id AND e.k = g.k + 1)
 SELECT user_id, max(n) AS runs, max(prev) AS last_run FROM g GROUP BY user_id""")
def cadence_gates(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    ran = twins.cadence_runs(events, "user_id", ("at", "event_id"), "at", 86_400_000).filter("ran")
    return ran.groupBy("user_id").agg(F.count(F.lit(1)).alias("runs"), F.max("at").alias("last_run"))


@query("unseen_flags", "SELECT doc_id AS id, doc_id NOT IN (SELECT doc_id FROM labels) AS is_new FROM documents")
def unseen_flags(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return present.new_since(ids, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
