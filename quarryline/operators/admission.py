"""The admission cascade: for every offer the first stage that drops it, and why."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.text import role_key, url_is_safe, url_key
from quarryline.operators.dedup import greedy_two_key
from quarryline.operators.rules import CountryRules, LocationRules, TitleRules, blocked_term, seats

ADMITTED = "ADMITTED"
#: Stages in the order in which they are tried and reported.
STAGES = ("NO LINK", "COMPANY", "TITLE", "LOCATION", "COUNTRY", "DUPLICATE", ADMITTED)


@dataclass(frozen=True)
class Gates:
    titles: TitleRules = field(default_factory=TitleRules)
    locations: LocationRules = field(default_factory=LocationRules)
    countries: CountryRules = field(default_factory=CountryRules)
    companies: tuple[str, ...] = ()


def gate_verdict(gates: Gates) -> Column:
    """(stage, reason) by the rules alone, for columns url, company, title and location; null if all pass."""
    location = F.coalesce("location", F.lit(""))
    places = seats(location)
    country_ok = F.when(
        F.size(places) > 1, F.exists(places, lambda s: gates.locations.passes(s) & gates.countries.passes(s))
    ).otherwise(gates.countries.passes(location))
    company = blocked_term("company", gates.companies)
    shown = F.when(location == "", "(empty)").otherwise(location)

    def drop(stage: str, reason: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))

    return (
        F.when(~url_is_safe("url"), drop("NO LINK", F.lit("the offer has no usable link")))
        .when(company.isNotNull(), drop("COMPANY", F.concat(F.lit("blocked company: "), company)))
        .when(~gates.titles.passes("title"), drop("TITLE", gates.titles.reason("title")))
        .when(~gates.locations.passes("location"), drop("LOCATION", F.concat(F.lit("outside the range: "), shown)))
        .when(gates.locations.blocks("title"), drop("LOCATION", F.lit("the title names a place outside the range")))
        .when(~country_ok, drop("COUNTRY", F.concat(F.lit("country switched off: "), location)))
    )


def admit(offers: DataFrame, gates: Gates, seen_urls: DataFrame | None = None, seen_roles: DataFrame | None = None) -> DataFrame:
    """Every offer with its keys, stage and reason; offers are (seq, url, company, title, location, ...).

    Rules come first, in one pass over the rows. What passes is held against the history
    (``seen_urls.url_key``, ``seen_roles.role_key``) and then against itself in ``seq`` order: an
    offer is a duplicate of an admitted one with the same address or, if its employer is
    known, the same company and role.
    """
    keyed = offers.withColumns({"url_key": url_key("url"), "role_key": role_key("company", "title")})
    judged = keyed.withColumn("verdict", gate_verdict(gates))
    for history, key in ((seen_urls, "url_key"), (seen_roles, "role_key")):
        flag = f"seen_{key}"
        if history is None:
            judged = judged.withColumn(flag, F.lit(False))
        else:
            known = history.select(F.col(key)).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
            judged = judged.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    fresh = judged.filter("verdict IS NULL AND NOT seen_url_key AND NOT seen_role_key")
    first = greedy_two_key(fresh.select("url_key", "role_key", "seq"), "url_key", "role_key", "seq")
    marked = judged.join(first.select("seq", F.lit(True).alias("first_here")), "seq", "left")
    same_link = F.lit("already seen (same link)")
    stage = (
        F.when(F.col("verdict").isNotNull(), F.col("verdict.stage"))
        .when(F.coalesce("first_here", F.lit(False)), ADMITTED)
        .otherwise("DUPLICATE")
    )
    reason = (
        F.when(F.col("verdict").isNotNull(), F.col("verdict.reason"))
        .when(F.coalesce("first_here", F.lit(False)), F.lit(None).cast("string"))
        .when(F.col("seen_url_key"), same_link)
        .when(F.col("seen_role_key"), "already seen (same company and role)")
        .otherwise("repeats an offer of this run")
    )
    names = [*offers.columns, "url_key", "role_key"]
    return marked.select(*names, stage.alias("stage"), reason.alias("reason"))


def stage_rank(stage: Column | str, order: tuple[str, ...] = STAGES) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col(stage) if isinstance(stage, str) else stage)


def funnel_counts(verdicts: DataFrame, order: tuple[str, ...] = STAGES) -> DataFrame:
    """Offers per stage in report order, stages without offers included."""
    stages = verdicts.sparkSession.createDataFrame([(s, i) for i, s in enumerate(order)], "stage string, place int")
    counted = verdicts.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return stages.join(counted, "stage", "left").select("place", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def explain_report(verdicts: DataFrame, order: tuple[str, ...] = STAGES) -> DataFrame:
    """Dropped offers by stage and title, as the report lists them."""
    dropped = verdicts.filter(F.col("stage") != ADMITTED)
    return dropped.orderBy(stage_rank("stage", order), "title", "seq").select("stage", "reason", "company", "title", "location", "seq")


def cap_per_source(offers: DataFrame, source: str, seq: str, most: int = 3000) -> DataFrame:
    """The first ``most`` offers of each source in order, and how many it had (``source_offers``).

    The cap is the feature: one board must not flood a list. Ranks are cut in each task
    before rows are shuffled; the counts are combined first.
    """
    place = F.row_number().over(Window.partitionBy(source).orderBy(seq))
    counts = offers.groupBy(F.col(source).alias("counted_source")).agg(F.count(F.lit(1)).alias("source_offers"))
    first = offers.withColumn("place", place).filter(F.col("place") <= most)
    return first.join(counts, F.col(source).eqNullSafe(F.col("counted_source"))).drop("counted_source")


def observed(verdicts: DataFrame, order: tuple[str, ...] = STAGES) -> tuple[DataFrame, Observation]:
    """``verdicts`` and an observation of them: how many there are, and how many of each stage.

    The figures come with whatever the verdicts are written to, in the same pass; they are there once
    it has run.
    """
    figures = [F.count_if(F.col("stage") == stage).alias(metric_name(stage)) for stage in order]
    seen = Observation()
    return verdicts.observe(seen, F.count(F.lit(1)).alias("found"), *figures), seen


def metric_name(stage: str) -> str:
    return stage.lower().replace(" ", "_")


def run_metrics(spark: SparkSession, seen: Observation, **facts) -> DataFrame:
    """One row of a run: the observed figures and other facts (calls, failures, time)."""
    figures = {name: int(value) for name, value in seen.get.items()} | facts
    return spark.createDataFrame([tuple(figures.values())], list(figures))
