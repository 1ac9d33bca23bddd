"""Feed parsers: payloads as text columns to canonical offer rows.

Every parser takes a DataFrame with a payload column and gives
``company, title, url, location, description`` (and more where a feed has it), one row per
posting. A payload that is no JSON, or lacks what a feed must have, gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import details_url, html_text, salary_text, slug_title, unescape_markup
from quarryline.session import broadcast_within

OFFER = ("company", "title", "url", "location", "description")


def _text(value: Column | str) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(""))


def feed_kind(explicit: Column, api: Column, url: Column) -> Column:
    """How a company's board is read: an explicit block, an API address, a sitemap, or the look of its page; null if unknown."""
    u = F.lower(_text(url))
    return (
        F.when(explicit.isin("workday", "oracle"), explicit)
        .when(F.contains(F.lower(_text(api)), F.lit("greenhouse")), "greenhouse")
        .when(u.rlike(r"sitemap[^/]*\.xml"), "sitemap")
        .when(u.rlike(r"^https?://jobs\.ashbyhq\.com/[^/?#]+"), "ashby")
        .when(u.rlike(r"^https?://jobs\.lever\.co/[^/?#]+"), "lever")
        .when(u.rlike(r"^https?://(?:job-boards|boards)[\w.-]*greenhouse\.io/[^/?#]+"), "greenhouse")
    )


def url_with_content(url: Column | str) -> Column:
    """A board address that asks for the texts too; unchanged if it does already or is empty."""
    u = _text(url)
    has = (u == "") | u.rlike("[?&]content=true(?:[^a-z]|$)")
    return F.when(has, u).otherwise(F.concat(u, F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("content=true")))


def parse_greenhouse(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    schema = "struct<jobs:array<struct<title:string,absolute_url:string,location:struct<name:string>,content:string>>>"
    jobs = feeds.select("company", F.explode(F.from_json(payload, schema)["jobs"]).alias("j")).filter("j IS NOT NULL")
    return jobs.select(
        "company", _text("j.title").alias("title"), _text("j.absolute_url").alias("url"),
        _text("j.location.name").alias("location"), unescape_markup("j.content").alias("description"),
    )


def parse_ashby(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    schema = "struct<jobs:array<struct<title:string,jobUrl:string,location:string,descriptionHtml:string,descriptionPlain:string>>>"
    jobs = feeds.select("company", F.explode(F.from_json(payload, schema)["jobs"]).alias("j")).filter("j IS NOT NULL")
    text = F.coalesce(F.nullif("j.descriptionHtml", F.lit("")), F.col("j.descriptionPlain"), F.lit(""))
    return jobs.select(
        "company", _text("j.title").alias("title"), _text("j.jobUrl").alias("url"), _text("j.location").alias("location"), text.alias("description")
    )


def parse_lever(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """The whole advert counts: the introduction, every list with its heading, and the closing words."""
    schema = (
        "array<struct<text:string,hostedUrl:string,categories:struct<location:string>,description:string,descriptionPlain:string,"
        "lists:array<struct<text:string,content:string>>,additional:string,additionalPlain:string>>"
    )
    listed = feeds.filter(F.ltrim(payload).startswith("["))
    jobs = listed.select("company", F.explode(F.from_json(payload, schema)).alias("j")).filter("j IS NOT NULL")
    either = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b, F.lit(""))
    lists = F.transform(F.coalesce("j.lists", F.array()), lambda x: F.concat(_text(x["text"]), F.lit(". "), _text(x["content"])))
    parts = F.concat(
        F.array(either(F.col("j.descriptionPlain"), F.col("j.description"))), lists, F.array(either(F.col("j.additionalPlain"), F.col("j.additional")))
    )
    text = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    return jobs.select(
        "company", _text("j.text").alias("title"), _text("j.hostedUrl").alias("url"), _text("j.categories.location").alias("location"), text.alias("description")
    )


def parse_workday(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """Needs ``base`` (the site's address). A mere count of locations is no location."""
    schema = "struct<jobPostings:array<struct<title:string,externalPath:string,locationsText:string>>>"
    jobs = feeds.select("company", "base", F.explode(F.from_json(payload, schema)["jobPostings"]).alias("j"))
    place = _text("j.locationsText")
    path = _text("j.externalPath")
    return jobs.select(
        "company", _text("j.title").alias("title"), F.when(path != "", F.concat("base", path)).otherwise("").alias("url"),
        F.when(F.trim(place).rlike(r"(?i)^\d+\s+locations$"), "").otherwise(place).alias("location"), F.lit("").alias("description"),
    )


def parse_oracle(feeds: DataFrame, payload: str = "payload") -> DataFrame:
    """Needs ``base`` (the preview address)."""
    schema = "struct<items:array<struct<requisitionList:array<struct<Id:string,Title:string,PrimaryLocation:string>>,TotalJobsCount:int>>>"
    first = F.try_element_at(F.from_json(payload, schema)["items"], F.lit(1))
    jobs = feeds.select("company", "base", F.explode(first["requisitionList"]).alias("j"))
    item = _text("j.Id")
    return jobs.select(
        "company", _text("j.Title").alias("title"), F.when(item != "", F.concat("base", F.lit("/"), item)).otherwise("").alias("url"),
        _text("j.PrimaryLocation").alias("location"), F.lit("").alias("description"),
    )


def parse_aggregator(feeds: DataFrame, payload: str = "payload", host_pattern: str = r"[^/]*aggregator\.[a-z.]+") -> DataFrame:
    """Needs ``country``; gives ``salary`` besides. Redirects become the offer's own page."""
    schema = (
        "struct<results:array<struct<id:string,title:string,redirect_url:string,company:struct<display_name:string>,"
        "location:struct<display_name:string,area:array<string>>,description:string,salary_min:double,salary_max:double,salary_is_predicted:string>>>"
    )
    jobs = feeds.select("country", F.explode(F.from_json(payload, schema)["results"]).alias("j"))
    places = F.concat(F.array("j.location.display_name"), F.coalesce("j.location.area", F.array()))
    currency = F.when(F.col("country") == "ch", "CHF ").otherwise("€")
    guessed = F.lower(_text("j.salary_is_predicted")).isin("1", "true")
    return jobs.select(
        F.coalesce("j.company.display_name", F.lit("Aggregator")).alias("company"), _text("j.title").alias("title"),
        details_url("j.redirect_url", F.col("j.id"), host_pattern).alias("url"),
        F.array_join(F.filter(places, lambda p: p.isNotNull() & (p != "")), ", ").alias("location"), _text("j.description").alias("description"),
        salary_text(F.col("j.salary_min"), F.col("j.salary_max"), guessed, currency).alias("salary"),
    )


def parse_cards(pages: DataFrame, html: str = "html", marker: str = 'data-entity-urn="urn:li:jobPosting:') -> DataFrame:
    """Offer cards of a listing page: (card_id, title, company, location). Patterns stay inside one tag."""
    cards = F.split(F.col(html), F.lit(marker))
    exploded = pages.select(F.explode(F.slice(cards, F.lit(2), F.greatest(F.size(cards) - 1, F.lit(0)))).alias("card"))
    take = lambda p: F.trim(F.regexp_extract("card", p, 1))
    linked = take(r"base-search-card__subtitle[^<>]*>\s*<a[^<>]*>\s*([^<]+)")
    named = take(r"base-search-card__subtitle[^<>]*>\s*([^<]+)")
    return exploded.select(
        F.regexp_extract("card", r"^(\d+)", 1).alias("card_id"), take(r"base-search-card__title[^<>]*>\s*([^<]+)").alias("title"),
        F.coalesce(F.nullif(linked, F.lit("")), F.nullif(named, F.lit("")), F.lit("Board")).alias("company"),
        take(r"job-search-card__location[^<>]*>\s*([^<]+)").alias("location"),
    ).filter("card_id <> ''")


def parse_json_ld(pages: DataFrame, html: str = "html") -> DataFrame:
    """The first job posting with a title in a page's linked data, for pages (page_id, html); others give no row."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^<>]*application/ld\+json[^<>]*>(.*?)</script>"), F.lit(1))
    block = pages.select("page_id", F.posexplode(blocks).alias("block_no", "block"))
    parsed = block.select("page_id", "block_no", F.try_parse_json("block").alias("v")).filter("v IS NOT NULL")
    many = lambda path: F.try_variant_get("v", path, "array<variant>")
    nodes = F.coalesce(many("$['@graph']"), many("$"), F.array("v"))
    node = parsed.select("page_id", "block_no", F.posexplode(nodes).alias("node_no", "node"))
    get = lambda path: F.try_variant_get("node", path, "string")
    title = F.trim(F.coalesce(get("$.title"), get("$.name"), F.lit("")))
    place = lambda name: F.nullif(F.trim(F.coalesce(get(f"$.jobLocation.address.{name}"), get(f"$.jobLocation[0].address.{name}"), F.lit(""))), F.lit(""))
    offers = node.filter(get("$['@type']") == "JobPosting").select(
        "page_id", "block_no", "node_no", title.alias("title"),
        F.concat_ws(", ", place("addressLocality"), place("addressRegion"), place("addressCountry")).alias("location"),
        html_text(get("$.description")).alias("description"),
    )
    first = Window.partitionBy("page_id").orderBy("block_no", "node_no")
    ranked = offers.filter("title <> ''").withColumn("place", F.row_number().over(first))
    return ranked.filter("place = 1").select("page_id", "title", "location", "description")


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml", match: str = "") -> DataFrame:
    """(site, url, slug) of a sitemap's addresses that contain ``match``."""
    urls = sitemaps.select("site", F.explode(F.regexp_extract_all(F.col(xml), F.lit("<loc>([^<]+)</loc>"), F.lit(1))).alias("raw"))
    found = urls.select("site", F.trim("raw").alias("url")).filter(F.contains("url", F.lit(match)))
    return found.withColumn("slug", slug_title("url"))


def pages_to_fetch(sitemaps: DataFrame, title_passes, match: str = "", most: int = 40) -> DataFrame:
    """Addresses worth a fetch: the title rule reads the slug before anything is downloaded.

    ``title_passes`` takes a Column. At most ``most`` of a site, in order of address.
    """
    wanted = sitemap_urls(sitemaps, match=match).filter(title_passes(F.col("slug")))
    order = Window.partitionBy("site").orderBy("url")
    return wanted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


#: Queries that are broadcast; more are joined without it.
MOST_QUERIES = 10_000


def requests(countries: DataFrame, queries: DataFrame) -> DataFrame:
    """One aggregator request for each country that is on and each query; the two are short lists."""
    return countries.filter("NOT off").select("country").crossJoin(broadcast_within(queries.select("query"), MOST_QUERIES))
