"""A bounded table of translated titles, and the lookups that fill it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import language_of_place

MOST = 2000
# fixed values: how countries are named in places and addresses, without accents, and what is spoken there
PLACE_LANGUAGES = (
    (r"\bfrance\b|\bfrancia\b|\bfrankrijk\b|\bmonaco\b|\.fr[/?]|\.fr$", "fr"),
    (r"\bspain\b|\bespana\b|\bspanje\b|\bspanien\b|\.es[/?]|\.es$", "es"),
    (r"\bgermany\b|\bdeutschland\b|\balemania\b|\bduitsland\b|\.de[/?]|\.de$", "de"),
    (r"\bnetherlands\b|\bnederland\b|\bholanda\b|\bpaises bajos\b|\.nl[/?]|\.nl$", "nl"),
    (r"\bbelgium\b|\bbelgie\b|\bbelgique\b|\bbelgica\b|\.be[/?]|\.be$", "nl"),
    (r"\bitaly\b|\bitalia\b|\.it[/?]|\.it$", "it"),
    (r"\bportugal\b|\.pt[/?]|\.pt$", "pt"),
)


def lookups(titles: DataFrame, known: DataFrame) -> DataFrame:
    """(title, place) that the table (title, place, translation) does not hold yet, each once; null places are empty."""
    asked = titles.select("title", F.coalesce("place", F.lit("")).alias("place")).filter("title IS NOT NULL").distinct()
    return asked.join(known.select("title", "place"), ["title", "place"], "left_anti").withColumn("language", F.lit("auto"))


def unchanged(title: Column, answer: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.trim(answer), F.lit("")), title)) == F.lower(title)


def second_lookups(asked: DataFrame, answers: DataFrame, rules: tuple[tuple[str, str], ...] = PLACE_LANGUAGES) -> DataFrame:
    """(title, place, language) to ask for again with the language told: titles that came back as they were, where the place has one.

    An unchanged title was in English or was not recognised; a wrong language does it no harm.
    """
    met = asked.select("title", "place").join(answers.select("title", "place", "answer"), ["title", "place"], "left")
    spoken = language_of_place("place", rules)
    return met.filter(unchanged(F.col("title"), F.col("answer"))).select("title", "place", spoken.alias("language")).filter("language IS NOT NULL")


def answered(first: DataFrame, second: DataFrame) -> DataFrame:
    """(title, place, translation) of answers to both lookups; the second one wins, empty answers are none."""
    told = lambda rows, name: rows.select("title", "place", F.nullif(F.trim("answer"), F.lit("")).alias(name))
    met = told(first, "one").join(told(second, "two"), ["title", "place"], "full")
    return met.select("title", "place", F.coalesce("two", "one").alias("translation")).filter("translation IS NOT NULL")


def merged(known: DataFrame, fresh: DataFrame, seq: int, most: int = MOST) -> DataFrame:
    """The table (title, place, translation, added) with fresh rows; of more than ``most`` the oldest go.

    A title that is held already keeps its age and takes the new translation. Rows added together are
    told apart by title and place. The bound is the feature: the table never outgrows it.
    """
    new = fresh.select("title", "place", F.col("translation").alias("new"))
    met = known.join(new, ["title", "place"], "full")
    rows = met.select("title", "place", F.coalesce("new", "translation").alias("translation"), F.coalesce("added", F.lit(seq).cast("long")).alias("added"))
    return rows.orderBy(F.desc("added"), "title", "place").limit(most)


def shown(titles: DataFrame, known: DataFrame) -> DataFrame:
    """``titles`` with ``translation``: that of the table, or the title itself."""
    table = known.select(F.col("title").alias("k_title"), F.col("place").alias("k_place"), F.col("translation").alias("k_translation"))
    met = titles.join(table, (F.col("title") == F.col("k_title")) & (F.coalesce("place", F.lit("")) == F.col("k_place")), "left")
    return met.select(*titles.columns, F.coalesce("k_translation", "title").alias("translation"))
