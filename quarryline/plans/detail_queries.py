"""Queries of detail requests and texts, nested sections, evidence, reviews, translations and run metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions.text import html_text
from quarryline.operators import admission, evidence, review, translations
from quarryline.plans.funnel_queries import D_STAGED, GATES, page_offers, query
from quarryline.operators.ordering import running
from quarryline.plans.text_queries import d_html
from quarryline.session import table
from quarryline.sources import details

# pages as offers of boards of every shape, by the number of the page; their markup is the answer
D_ADDRESSES = """addressed AS (SELECT page_id, html, CASE page_id % 6
  WHEN 0 THEN 'https://tenant' || page_id % 4 || '.wd3.myworkdayjobs.com/en-US/site/job/' || page_id WHEN 1 THEN 'https://board' || page_id % 3 || '.oraclecloud.com/hcmUI/CandidateExperience/en/sites/S1/requisitions/preview/' || page_id
  WHEN 2 THEN 'https://www.linkedin.com/jobs/view/' || page_id WHEN 3 THEN 'https://www.adzuna.fr/details/' || page_id WHEN 4 THEN url END AS address FROM pages)"""


def addressed(spark, sf_dir):
    n = F.col("page_id")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return table(spark, sf_dir, "pages").select(
        "page_id", "html",
        F.when(n % 6 == 0, text("https://tenant", (n % 4).cast("string"), ".wd3.myworkdayjobs.com/en-US/site/job/", n.cast("string")))
        .when(n % 6 == 1, text("https://board", (n % 3).cast("string"), ".oraclecloud.com/hcmUI/CandidateExperience/en/sites/S1/requisitions/preview/", n.cast("string")))
        .when(n % 6 == 2, text("https://www.linkedin.com/jobs/view/", n.cast("string"))).when(n % 6 == 3, text("https://www.adzuna.fr/details/", n.cast("string")))
        .when(n % 6 == 4, F.col("url")).alias("address"),
    )


D_PLANNED = D_ADDRESSES + """, planned AS (SELECT page_id, html, address, CASE page_id % 6 WHEN 0 THEN 'workday' WHEN 1 THEN 'oracle' WHEN 2 THEN 'guest' WHEN 3 THEN 'aggregator' WHEN 4 THEN 'page' END AS recipe,
 CASE page_id % 6 WHEN 0 THEN 'https://tenant' || page_id % 4 || '.wd3.myworkdayjobs.com/wday/cxs/tenant' || page_id % 4 || '/site/job/' || page_id
  WHEN 1 THEN 'https://board' || page_id % 3 || '.oraclecloud.com/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?onlyData=true&finder=ById;Id=%22' || page_id || '%22,siteNumber=%22S1%22'
  WHEN 2 THEN 'https://www.linkedin.com/jobs-guest/jobs/api/jobPosting/' || page_id ELSE address END AS request_url FROM addressed)"""


@query("detail_requests", "WITH " + D_PLANNED + r""", hosted AS (SELECT *, lower(regexp_extract(request_url, '^https?://([^/?#]+)', 1)) AS host, CASE WHEN page_id % 6 < 2 THEN 500 ELSE 1200 END AS gap FROM planned WHERE recipe IS NOT NULL)
 SELECT page_id AS seq, recipe, host, request_url, (sum(gap) OVER (PARTITION BY host ORDER BY page_id) - gap)::BIGINT AS at_ms FROM hosted""")
def detail_requests(spark, sf_dir):
    return details.request_plan(addressed(spark, sf_dir), "page_id", "address")


# every second answer comes, the others fail in all ways
D_REGION = "'<nav>menu</nav><section class=\"wide adp-body\">' || replace(replace(html, '<p>', '<section>'), '</p>', '</section>')"
D_TEXT = d_html
#: The running sum of depths over the pieces of a page behind its opening tag, and where it returns to nought.
D_SECTION = r"""pieces AS (SELECT page_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (SELECT page_id, string_split({html}, '<') AS p FROM {rows})),
 tags AS (SELECT *, contains(piece, '>') AS closed, lower(string_split(piece, '>')[1]) AS tag FROM pieces WHERE i > 1),
 opened AS (SELECT page_id, min(i) AS first FROM tags WHERE closed AND regexp_matches(tag, '^section\b') AND regexp_matches(tag, '\sclass\s*=\s*["''][^"'']*\badp-body\b') GROUP BY page_id),
 depths AS (SELECT page_id, i, piece, first, 1 + sum(CASE WHEN i = first OR NOT closed THEN 0 WHEN regexp_matches(tag, '^section\b') THEN 1 WHEN regexp_matches(tag, '^/section\b') THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth
  FROM tags JOIN opened USING (page_id) WHERE i >= first),
 ended AS (SELECT page_id, min(i) FILTER (depth = 0) AS stop FROM depths GROUP BY page_id),
 sections AS (SELECT page_id, string_agg(CASE WHEN i = first THEN substr(piece, length(string_split(piece, '>')[1]) + 2) ELSE piece END, '<' ORDER BY i) AS section
  FROM depths JOIN ended USING (page_id) WHERE stop IS NULL OR i < stop GROUP BY page_id)"""


@query("nested_sections", "WITH " + D_SECTION.format(html=D_REGION, rows="pages") + f" SELECT page_id, md5(coalesce(section, '')) AS section_md5, length(coalesce(section, '')) AS section_length, md5({D_TEXT('section')}) AS text_md5 FROM pages LEFT JOIN sections USING (page_id)")
def nested_sections(spark, sf_dir):
    html = F.concat(F.lit('<nav>menu</nav><section class="wide adp-body">'), F.replace(F.replace("html", F.lit("<p>"), F.lit("<section>")), F.lit("</p>"), F.lit("</section>")))
    found = table(spark, sf_dir, "pages").select("page_id", details.nested_section(html, "section", "adp-body").alias("section"))
    return found.select("page_id", F.md5("section").alias("section_md5"), F.length("section").cast("long").alias("section_length"), F.md5(html_text("section")).alias("text_md5"))


@query("detail_texts", "WITH " + D_PLANNED + f""", answered AS (SELECT *, CASE page_id % 7 WHEN 5 THEN 429 WHEN 6 THEN 404 ELSE 200 END AS status, {D_REGION} AS region FROM planned WHERE page_id % 11 <> 3),
 {D_SECTION.format(html='region', rows='answered')},
 told AS (SELECT a.*, CASE WHEN status <> 200 THEN '' WHEN page_id % 6 = 0 THEN {D_TEXT('html')} WHEN page_id % 6 = 1 THEN {D_TEXT("html || ' ' || html")} WHEN page_id % 6 = 3 THEN {D_TEXT('section')} ELSE {D_TEXT('html')} END AS text
  FROM answered a LEFT JOIN sections USING (page_id))
 SELECT p.page_id AS seq, p.recipe, coalesce(status = 200 AND p.page_id % 6 = 3 AND p.page_id % 13 <> 0, false) AS clean, p.page_id % 13 <> 0 AND p.recipe IS NOT NULL AND coalesce(status, 429) = 429 AS unread, status,
  md5(CASE WHEN p.page_id % 13 = 0 THEN 'had' WHEN p.page_id % 6 = 3 THEN trim('own ' || coalesce(text, '')) WHEN coalesce(text, '') <> '' AND p.recipe IS NOT NULL THEN text ELSE 'own' END) AS body_md5
 FROM planned p LEFT JOIN told USING (page_id)""")
def detail_texts(spark, sf_dir):
    offers = addressed(spark, sf_dir)
    n = F.col("page_id")
    region = F.concat(F.lit('<nav>menu</nav><section class="wide adp-body">'), F.replace(F.replace("html", F.lit("<p>"), F.lit("<section>")), F.lit("</p>"), F.lit("</section>")))
    payload = (
        F.when(n % 6 == 0, F.to_json(F.struct(F.struct(F.col("html").alias("jobDescription")).alias("jobPostingInfo"))))
        .when(n % 6 == 1, F.to_json(F.struct(F.array(F.struct(F.col("html").alias("ExternalResponsibilitiesStr"), F.lit("").alias("ExternalDescriptionStr"), F.col("html").alias("CorporateDescriptionStr"))).alias("items"))))
        .when(n % 6 == 3, region).otherwise(F.col("html"))
    )
    status = F.when(n % 7 == 5, 429).when(n % 7 == 6, 404).otherwise(200)
    answers = offers.filter("page_id % 11 <> 3").select(n.alias("seq"), status.alias("status"), payload.alias("payload"), F.lit(1).alias("tries"))
    # a first try was refused everywhere: the later answer counts
    answers = answers.unionByName(answers.select("seq", F.lit(403).alias("status"), F.lit("refused").alias("payload"), F.lit(0).alias("tries")))
    rows = offers.withColumns({"description": F.lit("<p>own</p>"), "jd": F.when(n % 13 == 0, "had")})
    found = details.detail_bodies(rows, answers, "page_id", "address")
    return found.select("seq", "recipe", "clean", "unread", "status", F.md5("body").alias("body_md5"))


# the orders of a customer are the deck of the user with its number; events tap on it
D_TAPS = """deck AS (SELECT o_custkey AS deck, o_orderkey AS offer_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders),
sizes AS (SELECT deck, count(*) - 1 AS last, min(offer_id) AS first_offer FROM deck GROUP BY deck),
taps AS (SELECT user_id AS deck, event_id AS seq, CASE event_type WHEN 'view' THEN 'next' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 THEN 'prev' ELSE 'seen' END WHEN 'signup' THEN 'no' WHEN 'purchase' THEN 'applied' ELSE CASE WHEN event_id % 4 = 0 THEN 'cur' ELSE 'undo' END END AS action,
  CASE WHEN event_id % 5 = 0 THEN first_offer END AS named, last, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events JOIN sizes ON user_id = deck),
cursor(deck, k, place, following) AS (SELECT deck, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM sizes
  UNION ALL SELECT t.deck, t.k, c.following, greatest(0, least(c.following + CASE action WHEN 'next' THEN 1 WHEN 'prev' THEN -1 ELSE 0 END, last)) FROM cursor c JOIN taps t ON t.deck = c.deck AND t.k = c.k + 1),
met AS (SELECT t.deck, t.seq, t.action, c.place, coalesce(named, d.offer_id) AS offer_id FROM taps t JOIN cursor c USING (deck, k) JOIN deck d ON d.deck = t.deck AND d.place = c.place),
acts AS (SELECT *, row_number() OVER (PARTITION BY deck, offer_id ORDER BY seq) AS n FROM met WHERE action IN ('seen', 'no', 'applied', 'undo')),
stand(deck, offer_id, n, seq, about, standing) AS (SELECT DISTINCT deck, offer_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM acts
  UNION ALL SELECT a.deck, a.offer_id, a.n, a.seq, CASE WHEN action = 'undo' THEN standing WHEN standing IS NULL THEN a.seq END, CASE WHEN action = 'undo' THEN NULL ELSE coalesce(standing, a.seq) END
  FROM stand s JOIN acts a ON a.deck = s.deck AND a.offer_id = s.offer_id AND a.n = s.n + 1),
log AS (SELECT m.deck, m.seq, m.action, m.place, m.offer_id, s.about, CASE WHEN m.action IN ('prev', 'next') THEN 'moved' WHEN m.action = 'cur' THEN 'none' WHEN m.action = 'undo' THEN CASE WHEN about IS NULL THEN 'nothing' ELSE 'undone' END
  WHEN about IS NULL THEN 'ignored' ELSE 'recorded' END AS effect FROM met m LEFT JOIN stand s ON s.seq = m.seq)"""


def reviews(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("deck"), F.col("o_orderkey").alias("offer_id"))
    deck = running(orders.withColumn("one", F.lit(1)), ("deck",), ("offer_id",), "one", "place").select("deck", (F.col("place") - 1).alias("place"), "offer_id")
    first = deck.filter("place = 0").select(F.col("deck").alias("f_deck"), F.col("offer_id").alias("first_offer"))
    kind, n = F.col("event_type"), F.col("event_id")
    action = (
        F.when(kind == "view", "next").when((kind == "click") & (n % 3 == 0), "prev").when(kind == "click", "seen").when(kind == "signup", "no")
        .when(kind == "purchase", "applied").when(n % 4 == 0, "cur").otherwise("undo")
    )
    events = table(spark, sf_dir, "events").join(first, F.col("user_id") == F.col("f_deck"), "left")
    taps = events.select(F.col("user_id").alias("deck"), n.alias("seq"), action.alias("action"), F.when(n % 5 == 0, F.col("first_offer")).alias("offer_id"))
    return deck, review.replayed(deck, taps)


@query("review_log", f"WITH RECURSIVE {D_TAPS} SELECT deck, seq, action, place, offer_id, effect, about FROM log")
def review_log(spark, sf_dir):
    return reviews(spark, sf_dir)[1]


@query("review_decisions", f"""WITH RECURSIVE {D_TAPS} SELECT deck, offer_id, action, seq, CASE action WHEN 'no' THEN 'feedback' WHEN 'applied' THEN 'applications' END AS journal,
 seq IN (SELECT about FROM log WHERE effect = 'undone') AS undone FROM log WHERE effect = 'recorded'""")
def review_decisions(spark, sf_dir):
    return review.decisions(reviews(spark, sf_dir)[1])


@query("after_review", f"""WITH RECURSIVE {D_TAPS}, kept AS (SELECT deck, offer_id, action FROM log WHERE effect = 'recorded' AND seq NOT IN (SELECT about FROM log WHERE effect = 'undone'))
 SELECT deck, offer_id, action AS decision FROM deck LEFT JOIN kept USING (deck, offer_id)""")
def after_review(spark, sf_dir):
    return review.after_review(*reviews(spark, sf_dir))


@query("state_records", """SELECT event_id AS seq, user_id + 20 AS id, event_type AS state, '' AS reason, title, company, title IS NOT NULL AS known FROM events LEFT JOIN (
 SELECT o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS title, arg_max(o_orderstatus, o_orderkey) AS company FROM orders GROUP BY ALL) a ON a.id = user_id + 20""")
def state_records(spark, sf_dir):
    commands = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") + 20).alias("id"), F.col("event_type").alias("state"), F.lit(None).cast("string").alias("reason"))
    sent = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("company"), F.col("o_orderkey").alias("seq"))
    return review.state_records(commands, sent)


# search terms: names of parts, the first two words of benchmark passages, and single words of them
D_TERMS = """terms AS (SELECT DISTINCT p_name AS term FROM part UNION SELECT array_to_string(string_split(text, ' ')[1:2], ' ') FROM benchmark UNION SELECT string_split(text, ' ')[item_id % 7 + 3] FROM benchmark UNION SELECT left(string_split(text, ' ')[4], 7) FROM benchmark),
folded AS (SELECT term, trim(lower(strip_accents(term))) AS t FROM terms WHERE trim(coalesce(term, '')) <> '')"""
D_BACKS = r"""CASE WHEN contains({text}, t) THEN regexp_matches({text}, '(^|[^\p{{L}}0-9])' || regexp_escape(t) || '($|[^\p{{L}}0-9])') ELSE false END OR (length(regexp_replace(t, '[^a-z]', '', 'g')) >= 6 AND contains({text}, left(regexp_replace(t, '[^a-z]', '', 'g'), 6)))"""


def search_terms(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").withColumn("words", F.split("text", " "))
    word = lambda n: F.get("words", n)
    found = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"))
    for term in (F.array_join(F.slice("words", 1, 2), " "), word((F.col("item_id") % 7 + 2).cast("int")), F.left(word(F.lit(3)), F.lit(7))):
        found = found.unionByName(passages.select(term.alias("term")))
    return found.distinct()


@query("term_evidence", f"WITH {D_TERMS}, d AS (SELECT doc_id, lower(strip_accents(text)) AS x FROM documents) SELECT doc_id AS text_id, term FROM d, folded WHERE {D_BACKS.format(text='x')}")
def term_evidence(spark, sf_dir):
    return evidence.evidence(table(spark, sf_dir, "documents"), "doc_id", "text", search_terms(spark, sf_dir), "term")


@query("missing_skills", f"""WITH {D_TERMS}, s AS (SELECT DISTINCT skill, lower(strip_accents(skill)) AS x FROM (SELECT unnest(string_split(text, ' ')) AS skill FROM benchmark))
 SELECT skill FROM s WHERE NOT EXISTS (FROM folded WHERE term IN (SELECT p_name FROM part UNION SELECT string_split(text, ' ')[item_id % 7 + 3] FROM benchmark) AND ({D_BACKS.format(text='s.x')}))""")
def missing_skills(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").withColumn("words", F.split("text", " "))
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).unionByName(passages.select(F.get("words", (F.col("item_id") % 7 + 2).cast("int")).alias("term")))
    return evidence.unbacked(passages.select(F.explode("words").alias("skill")), "skill", terms, "term")


@query("run_metrics", D_STAGED + """ SELECT count(*) AS found, count(*) FILTER (stage = 'NO LINK') AS no_link, count(*) FILTER (stage = 'COMPANY') AS company, count(*) FILTER (stage = 'TITLE') AS title, count(*) FILTER (stage = 'LOCATION') AS location,
 count(*) FILTER (stage = 'COUNTRY') AS country, count(*) FILTER (stage = 'DUPLICATE') AS duplicate, count(*) FILTER (stage = 'ADMITTED') AS admitted, 0 AS errors FROM staged""")
def run_metrics(spark, sf_dir):
    verdicts, seen = admission.observed(admission.admit(page_offers(spark, sf_dir), GATES))
    verdicts.select("seq", "stage").write.format("noop").mode("overwrite").save()
    return admission.run_metrics(spark, seen, errors=0)


# titles are names of parts in the countries of suppliers; what a translator would say is made from them
D_TITLES = """titles AS (SELECT p_name AS title, CASE p_partkey % 5 WHEN 0 THEN 'Lyon, France' WHEN 1 THEN 'https://x.example.de/' WHEN 2 THEN 'España' WHEN 3 THEN 'Oslo, Norway' END AS place FROM part),
asked AS (SELECT DISTINCT title, coalesce(place, '') AS place FROM titles WHERE title NOT LIKE 'r%'),
first AS (SELECT *, CASE WHEN length(title) % 3 = 0 THEN upper(title) WHEN length(title) % 3 = 1 THEN 'the ' || title END AS answer FROM asked),
second AS (SELECT title, place, CASE place WHEN 'Lyon, France' THEN 'fr' WHEN 'https://x.example.de/' THEN 'de' WHEN 'España' THEN 'es' END AS language FROM first WHERE lower(coalesce(answer, title)) = lower(title) AND place NOT IN ('', 'Oslo, Norway'))"""


def translator(spark, sf_dir):
    n = F.col("p_partkey") % 5
    place = F.when(n == 0, "Lyon, France").when(n == 1, "https://x.example.de/").when(n == 2, "España").when(n == 3, "Oslo, Norway")
    titles = table(spark, sf_dir, "part").select(F.col("p_name").alias("title"), place.alias("place"))
    held = titles.filter("title LIKE 'r%'").select("title", F.coalesce("place", F.lit("")).alias("place")).distinct()
    held = held.select("*", F.concat(F.lit("held "), "title").alias("translation"), F.length("title").cast("long").alias("added"))
    asked = translations.lookups(titles, held)
    answer = F.when(F.length("title") % 3 == 0, F.upper("title")).when(F.length("title") % 3 == 1, F.concat(F.lit("the "), "title"))
    return titles, held, asked, asked.withColumn("answer", answer)


@query("second_lookups", f"WITH {D_TITLES} SELECT * FROM second")
def second_lookups(spark, sf_dir):
    _, _, asked, first = translator(spark, sf_dir)
    return translations.second_lookups(asked, first)


@query("translations", f"""WITH {D_TITLES}, told AS (SELECT f.title, f.place, coalesce(CASE WHEN s.language <> 'es' THEN s.language || ' ' || f.title END, f.answer) AS translation, 100 AS added FROM first f LEFT JOIN second s ON f.title = s.title AND f.place = s.place),
 held AS (SELECT DISTINCT title, coalesce(place, '') AS place, 'held ' || title AS translation, length(title) AS added FROM titles WHERE title LIKE 'r%')
 SELECT * FROM (SELECT * FROM told WHERE translation IS NOT NULL UNION ALL SELECT * FROM held) ORDER BY added DESC, title, place LIMIT 200""")
def translated(spark, sf_dir):
    _, held, asked, first = translator(spark, sf_dir)
    second = translations.second_lookups(asked, first)
    second = second.withColumn("answer", F.when(F.col("language") != "es", F.concat("language", F.lit(" "), "title")))
    return translations.merged(held, translations.answered(first, second), 100, most=200)
