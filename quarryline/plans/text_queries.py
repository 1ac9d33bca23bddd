"""Queries of text, markup, address and verdict functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryline.functions import scalars, text
from quarryline.operators import liveness, screens
from quarryline.operators.rules import Country, CountryRules, LocationRules, TitleRules, blocked_term
from quarryline.functions.patterns import Rule
from quarryline.plans import fixtures as fx
from quarryline.session import table
from quarryline.sources import feeds
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


def with_rows(fixture: fx.Fixture, rest: str) -> str:
    return f"WITH {fixture.sql()} {rest}"


# DuckDB spellings of shared steps
D_SPACE = r"[\s\x{00a0}]"
D_ENTITIES = [("amp|#38", "&"), ("nbsp|#160", " "), ("quot|#34", '"'), ("apos|#39|rsquo|lsquo", "''"), ("lt|#60", "<"), ("gt|#62", ">"), ("ndash|#8211", "-"), ("mdash|#8212", "—")]


def d_decode(column: str) -> str:
    out = f"coalesce({column}, '')"
    for _ in range(3):
        for names, char in D_ENTITIES:
            out = f"regexp_replace({out}, '&(?:{names});', '{char}', 'gi')"
    return out


def d_squeezed(column: str) -> str:
    return f"trim(regexp_replace({column}, '{D_SPACE}+', ' ', 'g'))"


def d_html(column: str) -> str:
    """Markup as text: what follows each opening bracket, by the tag that stands there."""
    tag = "lower(split_part(p, '>', 1))"
    inline = "'/?(a|b|em|font|i|mark|small|span|strong|sub|sup|u)(\\s[\\s\\S]*)?'"
    gap = f"CASE WHEN regexp_full_match({tag}, {inline}) THEN '' WHEN {tag} = '/li' THEN '. ' ELSE ' ' END"
    pieces = f"string_split(regexp_replace(coalesce({column}, ''), '<!--[\\s\\S]*?-->', '', 'g'), '<')"
    text = f"array_to_string(list_transform({pieces}, lambda p, i: CASE WHEN i = 1 THEN p WHEN contains(p, '>') THEN {gap} || substr(p, strpos(p, '>') + 1) ELSE '<' || p END), '')"
    for names, char in (("nbsp|#160|#xa0", " "), ("amp", "&"), ("rsquo|lsquo|apos|#34|#39", "''"), ("quot", '"'), ("[a-z]+", " ")):
        text = f"regexp_replace({text}, '&({names});', '{char}', 'gi')"
    return rf"trim(regexp_replace({d_squeezed(text)}, '\.({D_SPACE}*\.)+', '.', 'g'))"


D_URL = r"regexp_replace(split_part(coalesce(url, ''), '?', 1), '/$', '')"


#: The inside of the first title element.
D_TITLE = "regexp_extract(html, '(?i)<title[^<>]*>([^<]*)', 1)"


def d_role(column: str) -> str:
    """A name in lower case without gender notes in brackets and percentages, dashes made even, no signs at its end."""
    inside = "lower(substr(s, 2, length(s) - 2))"
    note = f"""({d_squeezed(inside)} IN ('gn', 'all genders', 'all gender', 'allgenders', 'allgender') OR (regexp_full_match({inside}, '[mwfdxhv/|,.\\s]+')
 AND length(regexp_replace({inside}, '[^mwfdxhv]', '', 'g')) > 1 AND NOT regexp_matches('/' || {inside} || '/', '[/|,.]\\s*[/|,.]')))"""
    low = f"lower({column})"
    out = f"list_reduce(list_prepend({low}, list_filter(regexp_extract_all({low}, '\\([^()]*\\)'), lambda s: {note})), lambda t, s: replace(t, s, ' '))"
    out = f"regexp_replace({out}, '(^|[^A-Za-z0-9_])([0-9]{{2,3}}\\s*[-–]\\s*)?[0-9]{{2,3}}\\s*%', '\\1 ', 'g')"
    return rf"trim(regexp_replace({d_squeezed(f"translate({out}, '–—', '--')")}, '[\s,.;:-]+$', ''))"


#: A page as text.
D_PAGE_TEXT = d_html("html")


@query("url_keys", rf"SELECT page_id, {D_URL} AS url_key, regexp_matches(url, '^https?://[^\x00-\x20\x7f|]+$') AS is_safe FROM pages")
def url_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_key("url").alias("url_key"), text.url_is_safe("url").alias("is_safe"))


@query("html_texts", f"SELECT page_id, md5({d_html('html')}) AS text_md5, {d_html(D_TITLE)} AS title FROM pages")
def html_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text("html")).alias("text_md5"), text.html_title("html").alias("title"))


@query("slug_titles", r"""SELECT page_id, trim(regexp_replace(regexp_replace(url_decode(replace(list_last(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')), '+', '%2B')), '-\d+[a-z]*$', '', 'i'), '[-_]+', ' ', 'g')) AS slug FROM pages""")
def slug_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug_title("url").alias("slug"))


@query("fold_texts", "SELECT doc_id, md5(lower(strip_accents(text))) AS folded_md5 FROM documents")
def fold_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold("text")).alias("folded_md5"))


@query("clean_fields", with_rows(fx.FIELDS, rf"""SELECT id, {d_decode('text')} AS decoded,
 regexp_replace(regexp_replace(regexp_replace({d_decode('text')}, '[|\t\r\n]+', ' ', 'g'), '{D_SPACE}{{2,}}', ' ', 'g'), '^{D_SPACE}+|{D_SPACE}+$', '', 'g') AS clean,
 replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM fields"""))
def clean_fields(spark, sf_dir):
    return fx.FIELDS.frame(spark, sf_dir).select("id", text.decode_entities("text").alias("decoded"), text.clean_field("text").alias("clean"), text.escape_html("text").alias("escaped"))


@query("role_keys", with_rows(fx.ROLES, rf"""SELECT id,
 CASE WHEN {d_role(d_decode('company'))} NOT IN ('', 'aggregator', 'board', 'n/a') THEN {d_role(d_decode('company'))} || '::' || {d_role(d_decode('title'))} END AS role_key,
 CASE WHEN f NOT IN ('', 'aggregator', 'board', 'n/a') THEN f || '::' || {d_role("coalesce(title, '')")} END AS fuzzy_key
 FROM (SELECT *, trim(regexp_replace({d_role("coalesce(company, '')")}, '\s+(?:group|holding|nederland|netherlands|belgi[eë]|belgium|espa[nñ]a|france|deutschland|b\.?v\.?|n\.?v\.?|s\.?a\.?|s\.?l\.?|gmbh|ag|ltd|limited|inc|srl|spa)(?:[^\w].*$|$)', '')) AS f FROM roles)"""))
def role_keys(spark, sf_dir):
    return fx.ROLES.frame(spark, sf_dir).select("id", text.role_key("company", "title").alias("role_key"), text.fuzzy_role_key("company", "title").alias("fuzzy_key"))


@query("customer_role_keys", f"SELECT c_custkey, {d_role('c_name')} || '::' || {d_role('c_mktsegment')} AS role_key FROM customer")
def customer_role_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.role_key("c_name", "c_mktsegment").alias("role_key"))


@query("locations", with_rows(fx.PLACES, r"""SELECT id,
 array_to_string(list_filter(p, lambda x, i: list_position(list_transform(p, lambda y: lower(y)), lower(x)) = i), ', ') AS location,
 CASE WHEN lower(c) IN ('', 'n/a', 'india') OR regexp_matches(c, '^\d+\s+locations$', 'i') THEN '' ELSE c END AS city
 FROM (SELECT id, list_filter(list_transform(string_split(coalesce(location, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS p,
  trim(regexp_replace(regexp_replace(regexp_extract(coalesce(location, ''), '^[^|,]*'), '\([^()]*\)', '', 'g'), '\s+', ' ', 'g')) AS c FROM places)"""))
def locations(spark, sf_dir):
    return fx.PLACES.frame(spark, sf_dir).select("id", text.distinct_parts("location").alias("location"), text.city_of("location", ("India",)).alias("city"))


@query("salaries", """SELECT c_custkey, CASE WHEN greatest(lo, hi) < 10000 THEN '' ELSE CASE WHEN c_nationkey = 1 THEN '~' ELSE '' END || '€' ||
 CASE WHEN least(lo, hi) > 0 AND floor(least(lo, hi) / 1000 + 0.5) <> floor(greatest(lo, hi) / 1000 + 0.5)
 THEN (floor(least(lo, hi) / 1000 + 0.5))::BIGINT || '-' || (floor(greatest(lo, hi) / 1000 + 0.5))::BIGINT || 'k' ELSE (floor(CASE WHEN hi > 0 THEN greatest(hi, CASE WHEN lo > 0 THEN lo ELSE 0 END) ELSE lo END / 1000 + 0.5))::BIGINT || 'k' END END AS salary
 FROM (SELECT c_custkey, c_nationkey, c_acctbal * 10 AS lo, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 50000.0 END AS hi FROM customer)""")
def salaries(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    high = F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(50000.0)
    return rows.select("c_custkey", text.salary_text(F.col("c_acctbal") * 10, high, F.col("c_nationkey") == 1, F.lit("€")).alias("salary"))


PART_RULES = TitleRules(positive=("ring", "gizmo", "bolt", "ROD"), negative=(Rule("cold", ("ring",)), Rule("old"), Rule("red bolt")))


@query("title_gate", r"""SELECT p_partkey, pos AND NOT neg AS passes, CASE WHEN neg THEN 'rule' WHEN NOT pos THEN 'no-field' END AS bucket,
 CASE WHEN NOT pos THEN 'the title has no word of the field' WHEN neg THEN 'the title has the blocked word "' || CASE WHEN cold THEN 'cold' WHEN old THEN 'old' ELSE 'red bolt' END || '"' END AS reason
 FROM (SELECT *, cold OR old OR redbolt AS neg FROM (SELECT p_partkey, regexp_matches(p_name, 'ring|gizmo|bolt|\brod\b') AS pos,
  regexp_matches(p_name, '\bcold(s|es|en|in|innen)?\b') AND NOT regexp_matches(p_name, '\bring(s|es|en|in|innen)?\b') AS cold,
  regexp_matches(p_name, '\bold(s|es|en|in|innen)?\b') AS old, regexp_matches(p_name, '\bred bolt(s|es|en|in|innen)?\b') AS redbolt FROM part))""")
def title_gate(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", PART_RULES.passes("p_name").alias("passes"), PART_RULES.bucket("p_name").alias("bucket"), PART_RULES.reason("p_name").alias("reason")
    )


@query("company_block", r"""SELECT s_suppkey, r_name, CASE WHEN regexp_matches(lower(r_name), '\basia\b') THEN 'Asia' WHEN regexp_matches(lower(r_name), '\bmiddle\b') THEN 'middle' END AS blocked
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def company_block(spark, sf_dir):
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("s_suppkey", "r_name", blocked_term("r_name", ("Asia", "middle")).alias("blocked"))


PLACE_RULES = LocationRules(allow=("norway", "belgium", "remote", "france"), block=("india", "lyon"))
COUNTRIES = CountryRules((Country("France", "off", ("Lyon",)), Country("Norway", "yes"), Country("Spain", "No", ("País Vasco",))))


@query("location_gate", with_rows(fx.PLACES, r"""SELECT id, l = '' OR (CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: ok(x))) > 0 ELSE ok(l) END) AS passes,
 NOT regexp_matches(lower(strip_accents(l)), '\b(france|lyon|spain|pais vasco)\b') AS country_on
 FROM (SELECT id, coalesce(location, '') AS l, list_filter(list_transform(string_split(coalesce(location, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS s FROM places)""".replace(
    "ok(x)", r"NOT regexp_matches(lower(x), '\b(india|lyon)\b') AND regexp_matches(lower(x), 'norway|belgium|remote|france')").replace(
    "ok(l)", r"NOT regexp_matches(lower(l), '\b(india|lyon)\b') AND regexp_matches(lower(l), 'norway|belgium|remote|france')")))
def location_gate(spark, sf_dir):
    return fx.PLACES.frame(spark, sf_dir).select("id", PLACE_RULES.passes("location").alias("passes"), COUNTRIES.passes("location").alias("country_on"))


@query("title_screens", with_rows(fx.TITLES, r"""SELECT id, coalesce(regexp_matches(title, '\?{3,}|\x{fffd}'), false) AS broken,
 coalesce(regexp_matches(t, '(^|[^a-z])(danish|deutsch|dutch|flemish|french|german|italian|nederlands|norwegian|polish|portuguese|swedish)([^a-z)][^)]{0,24})?(parlant|speak|sprachig|sprechend)')
 AND NOT regexp_matches(t, '(^|[^a-z])((danish|deutsch|dutch|flemish|french|german|italian|nederlands|norwegian|polish|portuguese|swedish)(\s*/\s*|\s*,?\s+(or|oder|of|ou|o)\s+)english|english(\s*/\s*|\s*,?\s+(or|oder|of|ou|o)\s+)(danish|deutsch|dutch|flemish|french|german|italian|nederlands|norwegian|polish|portuguese|swedish))([^a-z]|$)'), false) AS demands_language
 FROM (SELECT *, lower(title) AS t FROM titles)"""))
def title_screens(spark, sf_dir):
    return fx.TITLES.frame(spark, sf_dir).select("id", screens.encoding_broken(F.col("title")).alias("broken"), screens.title_demands_language(F.col("title")).alias("demands_language"))


# no SQL engine reads clauses by position; the tests hold the literal rows against what they demand
@query("requirement_screens")
def requirement_screens(spark, sf_dir):
    rows = fx.DEMANDS.frame(spark, sf_dir).withColumn("s", screens.screen_columns(F.col("text"), F.col("title")))
    verdict = screens.experience_verdict(F.col("s"), F.col("title"), 2)
    stage = screens.screen_stage(F.col("s"), F.col("title"), F.coalesce("text", F.lit("")) == "", F.lit(False), 2)
    return rows.select("id", verdict["years"].alias("years"), verdict["why"].alias("why"), F.col("s.degree").alias("degree"), F.col("s.language").alias("language"), stage.alias("stage"))


@query("liveness_verdicts", with_rows(fx.PROOFS, r"""SELECT id, CASE WHEN status IN (404, 410) THEN 'expired' WHEN coalesce(status, 0) = 0 OR status >= 400 THEN 'uncertain'
 WHEN regexp_matches(final_url, '[?&]error=true', 'i') THEN 'expired' WHEN generic AND NOT hard AND signal THEN 'active' WHEN hard OR generic OR foreign_closed THEN 'expired'
 WHEN len(list_filter(controls, lambda c: regexp_matches(lower(c), '\b(apply|solicitar|bewerben|postuler)\b|(submit|start) application|ich bewerbe mich'))) > 0 THEN 'active'
 WHEN regexp_matches(b, '\d+\s+jobs?\s+found|search for jobs page is loaded') THEN 'expired' WHEN length(trim(b)) < 300 THEN 'expired' ELSE 'uncertain' END AS result
 FROM (SELECT *, regexp_matches(b, 'position has been filled|job no longer available|job is no longer available|job[^\n]*no longer open|(this job|job posting) has expired|no longer accepting applications|this (position|role|job) no longer|this (position|role|job) is no longer|this job is closed|this job listing is closed|job not found|job listing not found|the page you are looking for doesn.t exist') AS hard,
  regexp_matches(b, 'applications?\s+closed|applications?\s+(have|are|is)\s+closed|closed on [0-9]{1,2}\s+(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)|closed on (jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\w*\s+[0-9]{1,2}') AS generic,
  regexp_matches(b, 'diese stelle (nicht mehr|bereits) besetzt|diese stelle ist (nicht mehr|bereits) besetzt|offre (expirée|n''est plus disponible)') AS foreign_closed,
  regexp_matches(b, 'apply (now|today|here)|apply for this (job|position|role)|(submit|start) (your )?application|solliciteer|postule[rz]\b|jetzt bewerben|bewirb dich|ap[úu]ntate|inscr[íi]bete|env[íi]a tu (cv|candidatura)|aplicar? ahora') AS signal
  FROM (SELECT *, lower(coalesce(body, '')) AS b FROM proofs))"""))
def liveness_verdicts(spark, sf_dir):
    return fx.PROOFS.frame(spark, sf_dir).select("id", liveness.liveness(F.col("status"), F.col("final_url"), F.col("body"), F.col("controls"))["result"].alias("result"))


@query("judge_answers")
def judge_answers(spark, sf_dir):
    return fx.VERDICTS.frame(spark, sf_dir).select("id", scalars.parsed_verdict(F.col("text")).alias("v")).select("id", "v.*")


@query("confidences", """SELECT l_orderkey, l_linenumber, CASE WHEN v < 0 THEN 0.0 WHEN v <= 1 THEN v WHEN v <= 100 THEN v / 100 ELSE 1.0 END AS confidence
 FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN -l_tax WHEN 1 THEN l_discount WHEN 2 THEN l_quantity ELSE l_extendedprice END AS v FROM lineitem)""")
def confidences(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 4
    raw = F.when(kind == 0, -F.col("l_tax")).when(kind == 1, F.col("l_discount")).when(kind == 2, F.col("l_quantity")).otherwise(F.col("l_extendedprice"))
    return rows.select("l_orderkey", "l_linenumber", scalars.confidence(raw).alias("confidence"))


@query("order_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y') || '/' || month(o_orderdate) || '/' || day(o_orderdate) AS query_date,
 day(o_orderdate) || CASE WHEN day(o_orderdate) BETWEEN 11 AND 13 THEN 'th' WHEN day(o_orderdate) % 10 = 1 THEN 'st' WHEN day(o_orderdate) % 10 = 2 THEN 'nd' WHEN day(o_orderdate) % 10 = 3 THEN 'rd' ELSE 'th' END || strftime(o_orderdate, ' %B %Y') AS long_date,
 floor((epoch_ms(TIMESTAMP '1999-01-01') - epoch_ms(o_orderdate)) / 86400000.0)::BIGINT AS days FROM orders""")
def order_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.query_date(day).alias("query_date"), scalars.ordinal_date(day).alias("long_date"),
        scalars.floor_days(F.lit("1999-01-01").cast("timestamp"), day.cast("timestamp")).alias("days"),
    )


@query("commands", with_rows(fx.LINES, r"""SELECT id, CASE WHEN regexp_matches(t, '^seen(\s+#?\d+)+\s*$') THEN 'seen' WHEN regexp_matches(t, '^applied\s+#?\d+\s*$') THEN 'applied'
 WHEN regexp_matches(t, '^longshot\s+#?\d+') THEN 'longshot' WHEN regexp_matches(t, '^interview\s+#?\d+') THEN 'interview' WHEN regexp_matches(t, '^no\s+#?\d+') THEN 'reject' WHEN regexp_matches(t, '^no(\s|$)') THEN 'reject_which'
 WHEN regexp_matches(t, '^undo') THEN 'undo' WHEN regexp_matches(t, '^cover\s+#?\d+$') THEN 'cover' WHEN t = 'list' THEN 'list' WHEN t IN ('search', 'scan') THEN 'search' WHEN regexp_matches(t, '^/?(help|start)') THEN 'help' ELSE 'unknown' END AS command,
 CASE WHEN regexp_matches(t, '^(seen|applied|longshot|interview|no|undo|cover)') THEN array_to_string(list_transform(list_filter(regexp_extract_all(t, '\d+'), lambda x, i: list_position(regexp_extract_all(t, '\d+'), x) = i), lambda x: x), ',') ELSE '' END AS ids
 FROM (SELECT *, lower(trim(coalesce(text, ''))) AS t FROM typed)"""))
def commands(spark, sf_dir):
    c = twins.command(F.col("text"))
    return fx.LINES.frame(spark, sf_dir).select("id", c["command"].alias("command"), F.array_join(c["ids"].cast("array<string>"), ",").alias("ids"))


#: The inside of a page's first title and its place, for offers made from pages.
D_PLACE = "regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1)"
#: Escaped markup of a JSON text back to markup, the ampersand last.
D_CONTENT = """replace(replace(replace(replace(replace(coalesce(j->>'content', ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&')"""
D_LEVER = """array_to_string(list_filter(list_concat([coalesce(nullif(j->>'descriptionPlain', ''), j->>'description', '')],
  list_transform(CAST(coalesce(j->'lists', '[]') AS JSON[]), lambda x: coalesce(x->>'text', '') || '. ' || coalesce(x->>'content', '')), [coalesce(nullif(j->>'additionalPlain', ''), j->>'additional', '')]), lambda x: x <> ''), ' ')"""


@query("feed_offers", with_rows(fx.FEEDS, rf"""SELECT company, j->>'title' AS title, coalesce(j->>'absolute_url', '') AS url, coalesce(j->'location'->>'name', '') AS location, md5({D_CONTENT}) AS description_md5
  FROM (SELECT company, unnest(CAST(payload->'jobs' AS JSON[])) AS j FROM feeds WHERE kind = 'greenhouse' AND json_valid(payload)) WHERE j IS NOT NULL AND json_type(j) <> 'NULL'
 UNION ALL SELECT company, j->>'title', j->>'jobUrl', j->>'location', md5(coalesce(nullif(j->>'descriptionHtml', ''), j->>'descriptionPlain', '')) FROM (SELECT company, unnest(CAST(payload->'jobs' AS JSON[])) AS j FROM feeds WHERE kind = 'ashby' AND payload IS NOT NULL)
 UNION ALL SELECT company, j->>'text', j->>'hostedUrl', j->'categories'->>'location', md5({D_LEVER}) FROM (SELECT company, unnest(CAST(payload AS JSON[])) AS j FROM feeds WHERE kind = 'lever' AND payload LIKE '[%')
 UNION ALL SELECT company, j->>'title', CASE WHEN j->>'externalPath' = '' THEN '' ELSE base || (j->>'externalPath') END, CASE WHEN regexp_matches(j->>'locationsText', '^\d+\s+locations$', 'i') THEN '' ELSE j->>'locationsText' END, md5('') FROM (SELECT company, base, unnest(CAST(payload->'jobPostings' AS JSON[])) AS j FROM feeds WHERE kind = 'workday')
 UNION ALL SELECT company, j->>'Title', base || '/' || (j->>'Id'), j->>'PrimaryLocation', md5('') FROM (SELECT company, base, unnest(CAST(payload->'items'->0->'requisitionList' AS JSON[])) AS j FROM feeds WHERE kind = 'oracle')
 UNION ALL SELECT 'page ' || page_id, {D_TITLE}, CASE k WHEN 'workday' THEN url || '/' || page_id WHEN 'oracle' THEN url || '/' || page_id ELSE url END, {D_PLACE},
  md5(CASE k WHEN 'greenhouse' THEN html WHEN 'ashby' THEN html WHEN 'lever' THEN CASE WHEN {D_TITLE} = '' THEN '' ELSE {D_TITLE} || ' ' END || {D_PLACE} || '. ' || html || ' ' || page_id ELSE '' END)
  FROM pages, (VALUES ('greenhouse'), ('ashby'), ('lever'), ('workday'), ('oracle')) kinds(k)"""))
def feed_offers(spark, sf_dir):
    rows = fx.FEEDS.frame(spark, sf_dir)
    parsers = {"greenhouse": feeds.parse_greenhouse, "ashby": feeds.parse_ashby, "lever": feeds.parse_lever, "workday": feeds.parse_workday, "oracle": feeds.parse_oracle}
    out = None
    for kind, parse in parsers.items():
        part = parse(rows.filter(F.col("kind") == kind)).select("company", "title", "url", "location", F.md5("description").alias("description_md5"))
        out = part if out is None else out.unionByName(part)
    return out


@query("feed_cards", f"""SELECT * FROM (VALUES ('11', 'Diver', 'Gull', 'Bergen'), ('12', 'Cook', 'Reed', '')) t(card_id, title, company, location)
 UNION ALL SELECT (page_id + 1000)::VARCHAR, trim({D_TITLE}), h, h FROM (SELECT *, trim(regexp_extract(url, '^https?://([^/]+)', 1)) AS h FROM pages)""")
def feed_cards(spark, sf_dir):
    return feeds.parse_cards(fx.CARDS.frame(spark, sf_dir))


@query("page_json_ld", f"SELECT page_id, {d_html(D_TITLE)} AS title, md5({d_html(D_PAGE_TEXT)}) AS description_md5 FROM pages")
def page_json_ld(spark, sf_dir):
    html = F.concat(
        F.lit('<html><script type="application/ld+json">'), F.to_json(F.struct(F.lit("JobPosting").alias("@type"), text.html_title("html").alias("title"), text.html_text("html").alias("description"))),
        F.lit("</script></html>"),
    )
    return feeds.parse_json_ld(table(spark, sf_dir, "pages").withColumn("html", html)).select("page_id", "title", F.md5("description").alias("description_md5"))
