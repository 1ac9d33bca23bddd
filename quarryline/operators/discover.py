"""What the filters keep discarding, and which terms the evidence backs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.patterns import bounded, either
from quarryline.functions.phrases import REASON_DEMANDS, REASON_FIELD, REASON_NOISE
from quarryline.functions.text import fold, squeezed
from quarryline.operators.rules import NO_FIELD, RULE

STALE_DAYS, MOST_TITLES = 60, 20_000


def drop_bucket(reason: Column) -> Column:
    """no-field or rule, from the reason alone."""
    return F.when(F.lower(F.coalesce(reason, F.lit(""))).contains("no word of the field"), NO_FIELD).otherwise(RULE)


def title_key(title: Column) -> Column:
    return F.lower(squeezed(title))


def merge_drops(store: DataFrame, drops: DataFrame, today: Column, most: int = MOST_TITLES, stale_days: int = STALE_DAYS) -> DataFrame:
    """The recurrence store after a run: (key, title, why, bucket, n, first, last).

    ``store`` has those columns; ``drops`` are (title, why, bucket, seq). The first spelling and
    date stay, the latest reason wins, every drop counts. Titles not seen for ``stale_days``
    go (undated ones stay), and so do all beyond the ``most`` most frequent, newest first.
    """
    old = store.select("key", F.lit(-1).cast("long").alias("seq"), "title", "why", "bucket", F.col("n").cast("long").alias("n"), "first", "last")
    new = drops.select(
        title_key(F.col("title")).alias("key"), F.col("seq").cast("long").alias("seq"), "title", F.coalesce("why", F.lit("")).alias("why"),
        F.coalesce("bucket", drop_bucket(F.col("why"))).alias("bucket"), F.lit(1).cast("long").alias("n"),
        today.alias("first"), today.alias("last"),
    ).filter("key <> ''")
    merged = old.unionByName(new).groupBy("key").agg(
        F.min_by("title", "seq").alias("title"), F.max_by("why", "seq").alias("why"), F.max_by("bucket", "seq").alias("bucket"),
        F.sum("n").alias("n"), F.min_by("first", "seq").alias("first"), F.max_by("last", "seq").alias("last"),
    )
    fresh = merged.filter(F.col("last").isNull() | (F.col("last") >= F.date_sub(today, stale_days)))
    return fresh.orderBy(F.desc("n"), F.desc("last"), "key").limit(most)


def top_recurring(store: DataFrame, bucket: str = NO_FIELD, limit: int = 12, least: int = 2) -> DataFrame:
    """The titles of a bucket that recur most."""
    rows = store.filter((F.col("bucket") == bucket) & (F.col("n") >= least))
    return rows.orderBy(F.desc("n"), "title", "key").limit(limit)


STOP_WORDS = ("and", "the", "for", "und", "der", "die", "das", "les", "des", "los", "las", "con", "for", "von", "with")


def candidate_terms(titles: DataFrame, title: str, known: DataFrame | None = None, stop=STOP_WORDS) -> DataFrame:
    """(term, n, titles): one- and two-word terms of titles, how often, and in how many different titles."""
    words = F.filter(
        F.split(fold(title), r"[^\p{L}\p{Nd}+#.]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*stop) & ~w.rlike(r"^\d+$")
    )
    pairs = F.transform(
        F.when(F.size("words") > 1, F.sequence(F.lit(1), F.size("words") - 1)).otherwise(F.array()),
        lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)),
    )
    exploded = titles.select(F.col(title).alias("t"), words.alias("words")).select("t", F.explode(F.concat("words", pairs)).alias("term"))
    # counted for each title first: a title that repeats costs one row
    counted = exploded.groupBy("term", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("term").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("titles")
    )
    if known is not None:
        counted = counted.join(known.select(fold(known.columns[0]).alias("term")).distinct(), "term", "left_anti")
    return counted


def skills_per_title(found: DataFrame) -> DataFrame:
    """How many skills returned each title."""
    return found.groupBy("title").agg(F.count_distinct("skill").alias("skills"))


def barren_skills(skills: DataFrame, found: DataFrame) -> DataFrame:
    """Skills that returned nothing."""
    return skills.join(found.select("skill").distinct(), "skill", "left_anti")


def occupation_hits(skills: DataFrame, relations: DataFrame, most: int = 2) -> DataFrame:
    """(uri, title, term, essential, seq) of the occupations that need a term's skills.

    ``skills`` (term, skill, rank) are what a search for each term found, of which the first
    ``most`` count; ``relations`` (skill, uri, title, essential, nth) is the taxonomy.
    """
    place = F.row_number().over(Window.partitionBy("term").orderBy("rank", "skill"))
    first = skills.withColumn("place", place).filter(F.col("place") <= most).select("term", "skill", "place")
    return first.join(relations, "skill").select("uri", "title", "term", "essential", F.struct("place", "nth").alias("seq"))


def score_occupations(hits: DataFrame) -> DataFrame:
    """(uri, title, score, terms): two for an essential and one for an optional term.

    A term counts once for an occupation, as its first hit (``seq``) says.
    """
    once = hits.groupBy("uri", "term").agg(F.min_by("essential", "seq").alias("essential"), F.min(F.struct("seq", "title")).alias("t"))
    return once.groupBy("uri").agg(
        F.min("t")["title"].alias("title"), F.sum(F.when(F.col("essential"), 2).otherwise(1)).alias("score"), F.count(F.lit(1)).alias("terms")
    )


def reason_family(reason: Column) -> Column:
    """What kind of reason a rejection has: unstated, noise, field, requirements or other."""
    text = fold(reason)
    return (
        F.when((F.trim(text) == "") | (F.trim(text) == "(no reason)"), "unstated")
        .when(text.rlike("|".join(REASON_NOISE)), "noise")
        .when(text.rlike("|".join(REASON_FIELD)), "field")
        .when(text.rlike("|".join(REASON_DEMANDS)), "requirements")
        .otherwise("other")
    )


def term_records(terms: list[str], rejected: DataFrame, applied: DataFrame, still_passes: Column) -> DataFrame:
    """(term, rejected, already_fixed, applied, longshots) of the terms, in one pass over each table."""

    def per_term(rows: DataFrame, **counts: Column) -> DataFrame:
        text = fold("title")
        hits = F.array(*[F.when(F.contains(text, fold(F.lit(t))), F.lit(t)) for t in terms])
        found = rows.select("*", F.explode(F.array_compact(hits)).alias("term"))
        return found.groupBy("term").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])

    listed = rejected.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    gone = per_term(rejected, rejected=still_passes, already_fixed=~still_passes)
    longshot = F.coalesce("longshot", F.lit(False))
    sent = per_term(applied, applied=~longshot, longshots=longshot)
    joined = listed.join(gone, "term", "left").join(sent, "term", "left")
    return joined.select("term", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rejected", "already_fixed", "applied", "longshots")])


def backed(terms: list[str], evidence: Column) -> Column:
    """The terms a text backs: as a whole word, or by the first six letters of a longer one."""
    text = fold(evidence)
    found = []
    for term in terms:
        stem = "".join(c for c in term.lower() if "a" <= c <= "z")
        hit = text.rlike(either([bounded(term)]))
        found.append(F.when(hit | F.contains(text, F.lit(stem[:6])) if len(stem) >= 6 else hit, F.lit(term)))
    return F.array_compact(F.array(*found))


def stem_families(records: DataFrame, letters: int = 8) -> DataFrame:
    """One term of each family of words with the same beginning: the one rejected most."""
    order = Window.partitionBy(F.left(fold("term"), F.lit(letters))).orderBy(F.desc("rejected"), "term")
    return records.withColumn("place", F.row_number().over(order)).filter("place = 1").drop("place")


def cv_skills(lines: DataFrame) -> DataFrame:
    """(skill, line_no) under the skill headings of a CV given as (cv_id, line_no, line).

    A heading of the first two levels opens or closes the section; the lines of it are split at
    commas, slashes and semicolons, without bracketed asides, and only short phrases stay.
    """
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    opens = F.when((level > 0) & (level <= 2), F.lower("line").rlike("skill|competenc|aptitud"))
    order = Window.partitionBy("cv_id").orderBy("line_no")
    marked = lines.withColumns({"level": level, "open": F.last(opens, ignorenulls=True).over(order)})
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"^[-*]\s*", ""), r"\([^()]*\)", ""), r"\*\*", "")
    pieces = marked.filter("open AND level = 0").select("cv_id", "line_no", F.explode(F.split(body, "[,/;]")).alias("piece"))
    skill = pieces.select("cv_id", "line_no", F.trim(F.regexp_replace("piece", "[()]", "")).alias("skill"))
    fits = (
        F.length("skill").between(3, 34) & (F.size(F.split("skill", r"\s+")) <= 4) & F.lower("skill").rlike("[a-z]{3}")
        & ~F.col("skill").rlike(r"^\d") & ~F.lower("skill").rlike(r"^(?:native|[abc][12]|spanish|english|dutch|german|french)(?:[^a-z]|$)")
    )
    return skill.filter(fits).groupBy("cv_id", "skill").agg(F.min("line_no").alias("line_no"))
