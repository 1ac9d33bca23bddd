"""Date, number and verdict functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days of 24 hours between two timestamps, rounded down."""
    return F.floor((F.unix_millis(later) - F.unix_millis(earlier)) / DAY_MS).cast("long")


def days_before(day: Column, days: int) -> Column:
    """The date ``days`` before; null stays null."""
    return F.date_sub(day, days)


def query_date(day: Column) -> Column:
    """2026/7/9, as mailbox searches write dates."""
    return F.date_format(day, "yyyy/M/d")


def ordinal_date(day: Column) -> Column:
    """17th July 2026."""
    number = F.dayofmonth(day)
    tail = (
        F.when(number.between(11, 13), "th")
        .when(number % 10 == 1, "st")
        .when(number % 10 == 2, "nd")
        .when(number % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(number.cast("string"), tail, F.date_format(day, " MMMM yyyy"))


def confidence(raw: Column) -> Column:
    """A share between 0 and 1: percent become shares, what is no number or negative 0, more than 100 is 1."""
    value = raw.cast("string").try_cast("double")
    return (
        F.when(value.isNull() | F.isnan(value) | (value < 0), F.lit(0.0))
        .when(value <= 1, value)
        .when(value <= 100, value / 100)
        .otherwise(F.lit(1.0))
    )


SHOW_WORDS, HIDE_WORDS = ("show", "keep"), ("hide", "drop")


def _says(text: Column, words) -> Column:
    return F.lower(text).rlike(rf"(?:^|[^a-z0-9_])(?:{'|'.join(words)})(?:[^a-z0-9_]|$)")


def vote(raw: Column, show=SHOW_WORDS, hide=HIDE_WORDS) -> Column:
    """show or hide (show is tried first), or null."""
    text = F.coalesce(raw.cast("string"), F.lit(""))
    return F.when(_says(text, show), "show").when(_says(text, hide), "hide")


def parsed_verdict(text: Column, show=SHOW_WORDS, hide=HIDE_WORDS) -> Column:
    """(vote, reason, confidence) of a judge's answer.

    The JSON between the first and the last brace counts; without one, a keyed word; without
    that, the only vote word that the text has. An answer without a vote has confidence 0.
    """
    text = F.coalesce(text, F.lit(""))
    block = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = F.try_parse_json(F.when(block != "", block))
    field = lambda *names: F.coalesce(*[F.try_variant_get(parsed, f"$.{n}", "string") for n in names])
    json_vote = vote(field("vote", "decision", "verdict"), show, hide)
    json_reason = F.trim(F.coalesce(field("reason"), F.lit("")))
    shown = F.left(F.trim(text), F.lit(300))
    by_json = F.struct(
        json_vote.alias("vote"),
        F.when(json_vote.isNotNull() | (json_reason != ""), json_reason).otherwise(shown).alias("reason"),
        F.when(json_vote.isNotNull(), confidence(field("confidence"))).otherwise(F.lit(0.0)).alias("confidence"),
    )
    keyed = F.regexp_extract(text, r"""(?i)["']?(?:vote|decision|verdict)["']?\s*:\s*["']?\s*([a-z]+)""", 1)
    ambiguous = _says(text, show[:1]) & _says(text, hide[:1])
    plain = F.when(keyed != "", vote(keyed, show, hide)).when(~ambiguous, vote(text, show, hide))
    stated = F.regexp_extract(text, r"(?i)confidence[^0-9]*([01](?:\.\d+)?|0?\.\d+)", 1)
    by_text = F.struct(
        plain.alias("vote"),
        shown.alias("reason"),
        F.when(plain.isNotNull(), confidence(stated)).otherwise(F.lit(0.0)).alias("confidence"),
    )
    return F.when(parsed.isNotNull(), by_json).otherwise(by_text)


def affinity(title: Column, field_pattern: str, junior_pattern: str) -> Column:
    """Two for a title of the field, one for a junior one."""
    return F.when(title.rlike(field_pattern), 2).otherwise(0) + F.when(title.rlike(junior_pattern), 1).otherwise(0)


def positive_ids(values: Column) -> Column:
    """Distinct positive whole numbers of an array of texts, with or without a number sign."""
    numbers = F.transform(values, lambda v: F.regexp_replace(F.trim(v), "^#", "").try_cast("long"))
    return F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n > 0)))
