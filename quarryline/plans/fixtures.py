"""Rows of queries: whole tables read as what the operators expect, and literal rows beside them for rare cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.session import table


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


class Fixture:
    """Literal rows and those of whole tables, as a DataFrame and as a DuckDB common table."""

    def __init__(self, name: str, schema: str, rows: list[tuple], read: Callable[[SparkSession, str], DataFrame] | None = None, read_sql: str = ""):
        self.name, self.schema, self.rows, self.read, self.read_sql = name, schema, rows, read, read_sql

    def frame(self, spark: SparkSession, sf_dir: str | None = None) -> DataFrame:
        """The literal rows, and those of the tables in ``sf_dir`` if it is given."""
        literal = spark.createDataFrame(self.rows, self.schema)
        return literal.unionByName(self.read(spark, sf_dir).select(*literal.columns)) if sf_dir and self.read else literal

    def sql(self) -> str:
        """``name AS (...)`` for a WITH clause."""
        names = ", ".join(part.split()[0] for part in self.schema.split(", "))
        values = ",\n ".join("(" + ", ".join(map(_literal, row)) + ")" for row in self.rows)
        more = f" UNION ALL {self.read_sql}" if self.read else ""
        return f"{self.name}({names}) AS (SELECT * FROM (VALUES {values}){more})"


#: Added to keys of tables, so that they differ from those of literal rows.
BASE = 1000


def from_documents(**columns):
    """A reader of all documents, with an id and the given columns."""
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select((F.col("doc_id") + BASE).alias("id"), *[F.expr(e).alias(n) for n, e in columns.items()])


def from_turns(**columns):
    """A reader of all turns of conversations."""
    return lambda spark, sf_dir: table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn") + BASE).alias("id"), *[F.expr(e).alias(n) for n, e in columns.items()]
    )


def customer_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select((F.col("c_custkey") + BASE).alias("id"), F.concat_ws(", ", "n_name", "r_name", "n_name").alias("location"))


def page_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        (F.col("page_id") + BASE).alias("id"), F.lit(200).alias("status"), F.col("url").alias("final_url"), F.col("html").alias("body"),
        F.regexp_extract_all("html", F.lit("<a [^<>]*>([^<]*)"), F.lit(1)).alias("controls"),
    )


def page_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as an offer in a feed of each kind."""
    url, html = F.col("url"), F.col("html")
    title = F.regexp_extract(html, "(?i)<title[^<>]*>([^<]*)", 1)
    escaped = F.replace(F.replace(F.replace(html, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    place, number = F.regexp_extract(url, r"^https?://[^/]+/([a-z]{2})/", 1), F.col("page_id").cast("string")
    listed = {
        "greenhouse": F.struct(F.array(F.struct(title.alias("title"), url.alias("absolute_url"), F.struct(place.alias("name")).alias("location"), escaped.alias("content"))).alias("jobs")),
        "ashby": F.struct(F.array(F.struct(title.alias("title"), url.alias("jobUrl"), place.alias("location"), html.alias("descriptionHtml"))).alias("jobs")),
        "lever": F.array(F.struct(
            title.alias("text"), url.alias("hostedUrl"), F.struct(place.alias("location")).alias("categories"), title.alias("descriptionPlain"),
            F.array(F.struct(place.alias("text"), html.alias("content"))).alias("lists"), number.alias("additionalPlain"))),
        "workday": F.struct(F.array(F.struct(title.alias("title"), F.concat(F.lit("/"), number).alias("externalPath"), place.alias("locationsText"))).alias("jobPostings")),
        "oracle": F.struct(F.array(F.struct(F.array(F.struct(number.alias("Id"), title.alias("Title"), place.alias("PrimaryLocation"))).alias("requisitionList"))).alias("items")),
    }
    kinds = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.to_json(payload).alias("payload")) for kind, payload in listed.items()]))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page "), number).alias("company"), url.alias("base"), kinds.alias("k"))
    return pages.select("company", "k.kind", "base", "k.payload")


def page_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a card of a listing."""
    title = F.regexp_extract("html", "(?i)<title[^<>]*>([^<]*)", 1)
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    card = F.concat(
        F.lit('<ul><li data-entity-urn="urn:li:jobPosting:'), (F.col("page_id") + BASE).cast("string"), F.lit('"><h3 class="base-search-card__title">'), title,
        F.lit('</h3><h4 class="base-search-card__subtitle"><a href="#">'), host, F.lit('</a></h4><span class="job-search-card__location">'), host, F.lit("</span></li></ul>"),
    )
    return table(spark, sf_dir, "pages").select("page_id", card.alias("html"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a CV whose lines stand under a heading of skills."""
    lines = F.posexplode(F.split(F.concat(F.lit("## Skills\n"), F.coalesce("text", F.lit(""))), "\n"))
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + BASE).alias("cv_id"), lines.alias("line_no", "line"))


D_PLACE = "regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1)"
D_PAGE_FEED = """SELECT 'page ' || page_id, k.kind, url, k.payload FROM pages, (VALUES ('none', NULL)) k(kind, payload) WHERE false"""

FIELDS = Fixture("fields", "id long, text string", [
    (1, "Tide &amp; Current"), (2, "a &amp;amp;amp; b"), (3, "x|y\tz\nw"), (4, "&lt;b&gt;bold&lt;/b&gt;"), (5, None), (6, ""),
    (7, "  wide  gap  "), (8, "&quot;quoted&quot; &apos;word&apos;"), (9, "dash &ndash; long &mdash; end"), (10, "&#38;lt;"),
], from_documents(text="text"), "SELECT doc_id + 1000, text FROM documents")
ROLES = Fixture("roles", "id long, company string, title string", [
    (1, "Tidal Works", "Junior Tide Modeller (m/f/d)"), (2, "tidal works", "junior  tide modeller"), (3, "Tidal Works GmbH", "Junior Tide Modeller"),
    (4, "Aggregator", "Junior Tide Modeller"), (5, "", "Junior Tide Modeller"), (6, "Reed &amp; Sons", "Planner 80-100%"), (7, "Reed & Sons", "Planner"),
    (8, "Gull N.V.", "Diver - "), (9, None, "Diver"), (10, "Gull", "Diver (all genders)"), (11, "Gull Holding Benelux", "Diver – Senior"),
    (12, "Tern Nederland", "Cook (m / w / d) 80 – 100 %"), (13, "Auk España SL", "Cook (x w m), 1180% pay"), (14, "Group Auk", "Cook (m//f) (GN) a80%"), (15, "Eider Deutschland", "Cook (ALL  Genders) 12345-80%"),
    (16, "Knot Ag-West", "Clerk (f)"), (17, "Deutschland", "Clerk (m|w|x), -"),
], from_documents(company="source", title="text"), "SELECT doc_id + 1000, source, text FROM documents")
PLACES = Fixture("places", "id long, location string", [
    (1, "Antwerp, Belgium"), (2, "Lyon, Lyon, France"), (3, ""), (4, None), (5, "Lima; Bergen, Norway"), (6, "Remote"), (7, "3 Locations"),
    (8, "País Vasco (north), Spain"), (9, "Indianapolis"), (10, "India"), (11, "Ghent (Belgium), ghent, BELGIUM"), (12, "Norway; France"), (13, ";"),
], customer_places, "SELECT c_custkey + 1000, n_name || ', ' || r_name || ', ' || n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
TITLES = Fixture("titles", "id long, title string", [
    (1, "Junior Tide Modeller"), (2, "Senior Modeller"), (3, "GIS Analyst"), (4, "Registers Clerk"), (5, "Modellers wanted (German speaking)"),
    (6, "Analyst, German or English speaking"), (7, "Coast??? Planner"), (8, "Études côtières"), (9, ""), (10, None),
    (11, "Deutschsprachige Kraft"), (12, "Planner � Port"), (13, "French/English speaker, tide desk"), (14, "Sales Modeller for tide data"),
    (15, "Clerk, Dutch-speaking"), (16, "Clerk (fluent Dutch) speaking"), (17, "Polish and Czech speaker"), (18, "Swedish native and otherwise very far away speaker"), (19, "Italian, or English speakers"),
    (20, "English ou portuguese parlant"), (21, "undanish speaker"), (22, "Norwegian of English sprechend"), (23, "Flemish (or English) speaking"), (24, "Nederlandssprachig"),
], from_documents(title="text"), "SELECT doc_id + 1000, text FROM documents")
PROOFS = Fixture("proofs", "id long, status int, final_url string, body string, controls array<string>", [
    (1, 404, "https://a.example/1", "", []), (2, 503, "https://a.example/2", "x", []), (3, 0, "", "", []),
    (4, 200, "https://a.example/4?error=true", "long text", []), (5, 200, "https://a.example/5", "Sorry, this position has been filled. Apply now elsewhere", []),
    (6, 200, "https://a.example/6", "Applications closed on holidays. Apply now", []), (7, 200, "https://a.example/7", "Applications are closed", []),
    (8, 200, "https://a.example/8", "short", ["Easy Apply"]), (9, 200, "https://a.example/9", "12 jobs found", []),
    (10, 200, "https://a.example/10", "short", []), (11, 200, "https://a.example/11", "word " * 80, ["Menu"]), (12, None, None, None, None),
    (13, 200, "u", "The job is no longer available", []), (14, 200, "u", "This job, sadly, is no longer open", []), (15, 200, "u", "This job has expired", []),
    (16, 200, "u", "The job posting has expired", []), (17, 200, "u", "We are no longer accepting applications", []), (18, 200, "u", "This role is no longer ours. Apply now", []),
    (19, 200, "u", "This job listing is closed", []), (20, 200, "u", "Job not found", []), (21, 200, "u", "The page you are looking for doesn’t exist", []),
    (22, 200, "u", "Closed on 3 March. Jetzt bewerben", []), (23, 200, "u", "Closed on March 3", []), (24, 200, "u", "Diese Stelle ist bereits besetzt", []),
    (25, 200, "u", "Offre expirée", []), (26, 200, "u", "Cette offre n'est plus disponible", []), (27, 200, "u", "Applications have closed. Solliciteer!", []),
    (28, 200, "u", "Application is closed; apúntate", []), (29, 200, "u", "Applications closed. Inscríbete", []), (30, 200, "u", "Applications closed. Envía tu CV", []),
    (31, 200, "u", "Applications closed. Aplicar ahora", []), (32, 200, "u", "Applications closed. Postulez", []), (33, 200, "u", "Applications closed. Start your application", []),
    (34, 200, "u", "Search for jobs page is loaded", []), (35, 200, "u", "x", ["Solicitar"]), (36, 200, "u", "x", ["Ich bewerbe mich"]), (37, 200, "u", "x", ["Postuler"]), (38, 200, "u", "x", ["Reapply"]),
    (39, 200, "u", "Applications closed. Bewirb dich", []), (40, 200, "u", "Applications closed, diese Stelle ist besetzt. Apply here", []), (41, 200, "u", "Applications closed. Apply for this role", []),
], page_proofs, "SELECT page_id + 1000, 200, url, html, regexp_extract_all(html, '<a [^<>]*>([^<]*)', 1) FROM pages")
MAILS = Fixture("mails", "id long, subject string, snippet string, body string, sender string", [
    (1, "Your application", "Thank you for applying", "We have received your application", "Tidal <no-reply@tidal.example>"),
    (2, "Update", "News on your application", "Unfortunately we chose other candidates.", "hr@gull.example"),
    (3, "Interview", "Please schedule a call", "We would like to speak to you", "Ann Reed <ann@reed.example>"),
    (4, "Next steps", "How it goes on", "If selected, you come to an interview. We have received your application", "jobs@reed.example"),
    (5, "Tips for your interview", "How to shine", "Guides and tips for an interview", "blog@board.example"),
    (6, "Job alert", "New jobs for you", "Apply now. Unfortunately some are gone", "alert@board.example"),
    (7, "Undelivered Mail Returned to Sender", "address not found", "", "mailer@x.example"),
    (8, "Lunch", "Friday?", "See you", "Bo <bo@home.example>"), (9, None, None, None, None),
    (10, "Réponse", "Leider", "Leider müssen wir absagen", "x@y.example"),
], from_turns(subject="''", snippet="text", body="text", sender="concat(role, '@jobs.example')"), "SELECT conv_id * 100 + turn + 1000, '', text, text, role || '@jobs.example' FROM conversations")
VERDICTS = Fixture("answers", "id long, text string", [
    (1, '{"vote": "show", "reason": "fits", "confidence": 0.8}'), (2, 'Well: {"decision":"HIDE","reason":"far","confidence":"80"} end'),
    (3, "vote: keep, confidence 0.4"), (4, "I would show it"), (5, "show or hide? hard"), (6, "no idea"), (7, None), (8, '{"vote":"maybe","reason":"unclear"}'),
    (9, '{"vote":"drop","confidence":-3}'), (10, '{"vote":"show","confidence":250}'),
], from_turns(text="text"), "SELECT conv_id * 100 + turn + 1000, text FROM conversations")
REASONS = Fixture("reasons", "id long, reason string", [
    (1, ""), (2, None), (3, "(no reason)"), (4, "link is closed"), (5, "Wrong field for me"), (6, "asks for 5 years"), (7, "too far"), (8, "needs fluent Dutch"),
    (9, "a disclosed salary"), (10, "Ya no acepta solicitudes"), (11, "No es un trabajo para mí"), (12, "pide titulación"), (13, "demasiados años"), (14, "I don't want to be a clerk"),
    (15, "bans on boats"), (16, "no va el link"), (17, "Not the right area"), (18, "5 ans minimum"), (19, "reflotada"), (20, "no me gusta el puesto"),
], from_turns(reason="text"), "SELECT conv_id * 100 + turn + 1000, text FROM conversations")
LINES = Fixture("typed", "id long, text string", [
    (1, "seen 3 #4 4"), (2, "Applied #12"), (3, "no 7 too far away"), (4, "no"), (5, "undo"), (6, "undo 9"), (7, "interview 5 on Monday"), (8, "list"),
    (9, "hello there"), (10, None), (11, "longshot 8 worth it"), (12, "scan"), (13, "cover 2"), (14, "/start yes"),
], from_turns(text="text"), "SELECT conv_id * 100 + turn + 1000, text FROM conversations")
FEEDS = Fixture("feeds", "company string, kind string, base string, payload string", [
    ("Gull", "greenhouse", "", '{"jobs":[{"title":"Diver","absolute_url":"https://g.example/1","location":{"name":"Bergen"},"content":"&lt;p&gt;Deep &amp;amp; cold&lt;/p&gt;"},null,{"title":"Cook"}]}'),
    ("Reed", "ashby", "", '{"jobs":[{"title":"Planner","jobUrl":"https://r.example/1","location":"Ghent","descriptionHtml":"","descriptionPlain":"Plan it"}]}'),
    ("Tern", "lever", "", '[{"text":"Sailor","hostedUrl":"https://t.example/1","categories":{"location":"Ostend"},"descriptionPlain":"Sail.","lists":[{"text":"Needs","content":"knots"}],"additional":"Bye"}]'),
    ("Auk", "workday", "https://auk.example/en", '{"jobPostings":[{"title":"Clerk","externalPath":"/job/1","locationsText":"2 Locations"},{"title":"Guard","externalPath":"","locationsText":"Oslo"}]}'),
    ("Eider", "oracle", "https://eider.example/preview", '{"items":[{"requisitionList":[{"Id":"77","Title":"Welder","PrimaryLocation":"Turku"}],"TotalJobsCount":1}]}'),
    ("Broken", "greenhouse", "", '{"jobs":['), ("Empty", "lever", "", '{"jobs":[]}'), ("None", "ashby", "", None),
], page_feeds, D_PAGE_FEED)
DEMANDS = Fixture("demands", "id long, title string, text string", [
    (1, "Planner", "You must have 5+ years of experience."), (2, "Planner", "Founded 30 years ago, we have 25 years of experience."),
    (3, "Planner", "Wir suchen jemanden mit drei bis fünf Jahren Erfahrung."), (4, "Planner", "Ideally 4 years of experience."),
    (5, "Planner", "More than 3 years experience required."), (6, "Planner", "Up to 5 years of experience required."),
    (7, "Planner", "You don’t need 5 years of experience."), (8, "Planner", "Several years of experience required."),
    (9, "Planner", "1 year of experience in a similar role required."), (10, "Planner", "A master's degree is required."),
    (11, "Planner", "A bachelor degree in mechanical engineering is required."), (12, "Planner", "Degree in mechanical engineering preferred."),
    (13, "Planner", "Fluent German required."), (14, "Planner", "German is a plus."), (15, "Planner", "Fluent German? No."), (16, "Planner", None), (17, "Planner", ""),
    (18, "Planner", "Bachelor or master's degree required, or equivalent experience."), (19, "Planner", "Contract of 2 years. Experience required."),
], from_documents(title="source", text="text"), "SELECT doc_id + 1000, source, text FROM documents")
CV = Fixture("cv", "cv_id long, line_no int, line string", [
    (1, 1, "# Ann Reed"), (1, 2, "Likes the sea, boats"), (1, 3, "## Skills"), (1, 4, "- Python, GIS (basic), tide tables"), (1, 5, "### More"),
    (1, 6, "Survey/Mapping; 3 things, native Dutch"), (1, 7, "## Work"), (1, 8, "Sailing, Rowing"), (2, 1, "## Competences"), (2, 2, "Welding, Welding"),
], document_lines, "SELECT doc_id + 1000, generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT doc_id, string_split('## Skills' || chr(10) || coalesce(text, ''), chr(10)) AS l FROM documents)")
CARDS = Fixture("cards", "page_id long, html string", [
    (1, '<ul><li data-entity-urn="urn:li:jobPosting:11"><h3 class="base-search-card__title"> Diver </h3><h4 class="base-search-card__subtitle"><a href="#"> Gull </a></h4><span class="job-search-card__location">Bergen</span></li>'
        '<li data-entity-urn="urn:li:jobPosting:12"><h3 class="base-search-card__title">Cook</h3><h4 class="base-search-card__subtitle">Reed</h4></li></ul>'),
    (2, "<p>nothing here</p>"), (3, None), (4, '<li data-entity-urn="urn:li:jobPosting:x">'),
], page_cards, "SELECT page_id, NULL FROM pages WHERE false")
