"""Three judges: their vote, the journal, and how it agrees with what the user decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import offer_key, unfenced

SHOW, HIDE, TIE, SEEN = "show", "hide", "tie", "seen"
#: Which decision counts when several name the same offer.
PRIORITY = {SEEN: 1, HIDE: 2, SHOW: 3}


def majority(votes: Column) -> Column:
    """show or hide with two votes and more; anything else is a tie. Null and other votes do not count."""
    count = lambda v: F.size(F.filter(votes, lambda x: x == v))
    return F.when(count(SHOW) >= 2, SHOW).when(count(HIDE) >= 2, HIDE).otherwise(TIE)


def usable(verdicts: Column) -> Column:
    """No judge failed; a failure is not a vote, and such a record is not journalled."""
    return ~F.exists(F.map_values(verdicts), lambda v: F.coalesce(v["failed"], F.lit(False)))


def user_decisions(applied: DataFrame, feedback: DataFrame, pending: DataFrame) -> DataFrame:
    """(url, id, decision) of everything the user said: applied (no long shots), rejected, marked as seen."""
    show = applied.filter(~F.coalesce("longshot", F.lit(False))).select("url", "id", F.lit(SHOW).alias("decision"))
    hide = feedback.select("url", "id", F.lit(HIDE).alias("decision"))
    seen = pending.filter("by_user").select("url", "id", F.lit(SEEN).alias("decision"))
    return show.unionByName(hide).unionByName(seen)


def reconcile(journal: DataFrame, decisions: DataFrame) -> DataFrame:
    """The journal with ``user_decision`` filled in: by address, else by id; filled ones are left alone.

    Of several decisions on one offer, applied beats rejected beats seen.
    """
    rank = F.when(F.col("decision") == SHOW, PRIORITY[SHOW]).when(F.col("decision") == HIDE, PRIORITY[HIDE]).otherwise(PRIORITY[SEEN])

    def best(key: str) -> DataFrame:
        return decisions.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"d_{key}")).agg(
            F.max_by("decision", rank).alias(f"by_{key}")
        )

    joined = journal.join(best("url"), F.col("url") == F.col("d_url"), "left").join(best("id"), F.col("id") == F.col("d_id"), "left")
    decided = F.coalesce("user_decision", "by_url", "by_id")
    return joined.select(*[c for c in journal.columns if c != "user_decision"], decided.alias("user_decision"))


def agreement(journal: DataFrame) -> DataFrame:
    """(user_decision, council, n, agrees) over decided records."""
    decided = journal.filter(F.col("user_decision").isin(SHOW, HIDE) & F.col("council").isin(SHOW, HIDE))
    return decided.groupBy("user_decision", "council").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "agrees", F.col("user_decision") == F.col("council")
    )


def unjudged(offers: DataFrame, journal: DataFrame) -> DataFrame:
    """Offers whose key is not in the journal."""
    keyed = offers.withColumn("q_offer", offer_key("url", "company", "title"))
    known = journal.select(offer_key("url", "company", "title").alias("q_offer")).distinct()
    return keyed.join(known, "q_offer", "left_anti").drop("q_offer")


def council_tags(offers: DataFrame, journal: DataFrame) -> DataFrame:
    """Offers with the council's last word: by address, else by id, else null."""

    def last(key: str) -> DataFrame:
        return journal.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias(f"j_{key}")).agg(F.max_by("council", "seq").alias(f"said_{key}"))

    joined = offers.join(last("url"), F.col("url") == F.col("j_url"), "left").join(last("id"), F.col("id") == F.col("j_id"), "left")
    return joined.select(*offers.columns, F.coalesce("said_url", "said_id").alias("council"))


def batch_tally(journal: DataFrame) -> DataFrame:
    """How many records say show, hide or tie."""
    return journal.groupBy("council").agg(F.count(F.lit(1)).alias("n"))


def dropped_sample(explained: DataFrame, journal: DataFrame, limit: int, stages=("TITLE", "LANGUAGE", "YEARS", "DEGREE")) -> DataFrame:
    """The first ``limit`` dropped offers of the stages a judge can question, without judged ones."""
    fresh = unjudged(explained.filter(F.col("stage").isin(*stages)), journal)
    return fresh.orderBy("seq").limit(limit)


def work_list(presented: DataFrame, dropped: DataFrame) -> DataFrame:
    """What a batch judges: presented offers and the sample of dropped ones."""
    return presented.withColumn("bot_decision", F.lit(SHOW)).unionByName(dropped.withColumn("bot_decision", F.lit(HIDE)))


def judge_prompt(brief: Column, title: Column, company: Column, body: Column, limit: int = 6000) -> Column:
    """A judge's prompt; the offer is fenced and cannot close its fence."""
    part = lambda c: unfenced(F.coalesce(c, F.lit("")))
    return F.concat(brief, F.lit("\n<<<\n"), part(title), F.lit("\n"), part(company), F.lit("\n"), F.left(part(body), F.lit(limit)), F.lit("\n>>>"))


def entry_text(record_title: Column, company: Column, council: Column, decision: Column) -> Column:
    """A journal entry as one line."""
    return F.format_string("%s | %s | council: %s | you: %s", company, record_title, council, F.coalesce(decision, F.lit("-")))
