"""Mail: what a message says, which application it belongs to, and where each application stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.phrases import (
    ACKNOWLEDGED,
    ADVICE,
    ALERT,
    ALERT_DECLARED,
    AUTOMATED,
    BOUNCED,
    CONDITIONAL,
    INTERVIEW,
    REJECTED,
)
from quarryline.functions.phrases import NAME_NOISE as NOISE
from quarryline.functions.scalars import floor_days
from quarryline.functions.text import compact_name, fold, folded_words, name_tokens, sender_domain
from quarryline.operators import pairs

LAG_DAYS, GHOSTED_DAYS = 2, 60
FACES = ("acknowledged", "interview", "rejected")


def said_outright(text: Column, pattern: str, conditional: str = CONDITIONAL) -> Column:
    """A sentence has the phrase and no condition stands before it."""
    return F.exists(
        F.split(text, "[.!?;·•]+"),
        lambda s: s.rlike(pattern) & ~F.regexp_extract(s, rf"^(.*?)(?:{pattern})", 1).rlike(conditional),
    )


def message_kind(subject: Column, snippet: Column, body: Column) -> Column:
    """bounced, alert, rejected, interview, acknowledged, or null; the first that fits."""
    part = lambda c: F.coalesce(c, F.lit(""))
    opening = fold(F.concat_ws(" ", part(subject), part(snippet)))
    text = fold(F.concat_ws(" ", part(subject), part(snippet), part(body)))
    return (
        F.when(F.trim(text) == "", F.lit(None).cast("string"))
        .when(text.rlike(BOUNCED), "bounced")
        .when(opening.rlike(ALERT_DECLARED), "alert")
        .when(said_outright(text, REJECTED), "rejected")
        .when(said_outright(text, INTERVIEW) & ~opening.rlike(ADVICE), "interview")
        .when(text.rlike(ACKNOWLEDGED), "acknowledged")
        .when(text.rlike(ALERT), "alert")
    )


def looks_automated(sender: Column) -> Column:
    return fold(sender).rlike(AUTOMATED)


def mail_window(applications: DataFrame) -> DataFrame:
    """(since): a day before the oldest application, the bound for reading a mailbox."""
    return applications.agg((F.min("ts") - F.expr("INTERVAL 1 DAY")).alias("since"))


def score_links(messages: DataFrame, applications: DataFrame, noise=NOISE, platforms: tuple[str, ...] = (), deciding: bool = False) -> DataFrame:
    """(message_id, app_id, identity, score, why) for every pair with something that identifies it.

    That is a company hit or two title hits: words of the name among those of the message, a compact name
    of four letters and more among them, one of six and more anywhere in the message as one word. The pairs
    grow with messages times applications, so they are made where both meet (:mod:`pairs`) and not shuffled.
    ``deciding`` leaves out the pairs that :func:`resolve_links` gives the same result without.
    """
    squeezed = lambda folded: F.regexp_replace(folded, "[^a-z0-9]+", "")
    m = messages.select(
        "id", F.unix_millis("date").alias("at"), fold(F.concat_ws(" ", "subject", "snippet", "body")).alias("said"),
        fold(F.concat_ws(" ", "from", sender_domain("from", platforms))).alias("sender"),
    )
    words, more = folded_words(F.col("said")), folded_words(F.col("sender"))
    m = m.select("id", "at", words.alias("words"), F.array_except(more, words).alias("more"), F.concat(squeezed("said"), squeezed("sender")).alias("text"))
    compact, names = compact_name("company", noise), F.array_distinct(name_tokens("company", noise))
    a = applications.select(
        "id", F.unix_millis("ts").alias("at"),
        F.when(F.length(compact).between(2, 5), F.array_union(names, F.array(compact))).otherwise(names).alias("words"),
        name_tokens("title", noise).alias("more"), compact.alias("text"), F.try_element_at(name_tokens("location", noise), F.lit(1)).alias("city"),
    )
    days = F.col("apart") / 86_400_000
    by_date = F.when(days <= 1, 3).when(days <= 5, 2).when(days <= 30, 1).otherwise(0)
    why = F.array_compact(
        F.array(
            F.when(F.col("company"), "company"),
            F.when(F.col("title") == pairs.TITLE, "title").when(F.col("title") == pairs.PARTIAL, "title-partial"),
            F.when(by_date == 3, "same-day").when(by_date == 2, "within-days").when(by_date == 1, "within-weeks"),
            F.when(F.col("in_city"), "city"),
        )
    )
    identity = (F.when(F.col("company"), pairs.COMPANY).otherwise(0) + F.col("title")).cast("int")
    return pairs.meet(m, a, LAG_DAYS * 86_400_000, deciding).select(
        "message_id", "app_id", identity.alias("identity"),
        (identity + by_date + F.when(F.col("in_city"), 1).otherwise(0)).cast("int").alias("score"), why.alias("why"),
    )


def resolve_links(messages: DataFrame, scored: DataFrame, margin: int = 1) -> DataFrame:
    """(message_id, app_id, kind, outcome, score): one link per clear message, all candidates of a tie, or an orphan.

    The best identity wins if it leads by ``margin`` or stands alone. A bounce links to all
    that tie; for any other message a tie is reported and nothing is linked.
    """
    order = Window.partitionBy("message_id").orderBy(F.desc("identity"), F.desc("score"), "app_id")
    everyone = Window.partitionBy("message_id")
    ranked = (
        scored.withColumn("place", F.row_number().over(order))
        .withColumn("gap", F.first("identity").over(order) - F.lead("identity").over(order))
        .withColumn("best", F.max("identity").over(everyone))
        .withColumn("clear", F.max(F.when(F.col("place") == 1, F.coalesce(F.col("gap") >= margin, F.lit(True)))).over(everyone))
    )
    top = ranked.filter((F.col("clear") & (F.col("place") == 1)) | (~F.col("clear") & (F.col("identity") == F.col("best"))))
    outcome = F.when(F.col("app_id").isNull(), "orphan").when(F.col("clear") | (F.col("kind") == "bounced"), "link").otherwise("tie")
    return messages.select(F.col("id").alias("message_id"), "kind").join(top, "message_id", "left").select(
        "message_id", "app_id", "kind", outcome.alias("outcome"), "score"
    )


def link_events(outcomes: DataFrame, messages: DataFrame) -> DataFrame:
    """(app_id, kind, at): the linked messages of :func:`resolve_links` as events of their applications. Ties and orphans are none."""
    sent = messages.select(F.col("id").alias("message_id"), F.col("date").alias("at"))
    linked = outcomes.filter((F.col("outcome") == "link") & F.col("app_id").isNotNull())
    return linked.join(sent, "message_id").select("app_id", "kind", "at")


def application_states(applications: DataFrame, events: DataFrame, today: Column) -> DataFrame:
    """One row per application from its linked ``events`` (app_id, kind, at).

    A bounce counts only without a reply; a rejection ends it; otherwise the furthest stage
    reached. No reply, or only an acknowledgement, turns to ghosted after 60 silent days.
    """
    reached = events.groupBy("app_id").agg(
        F.bool_or(F.col("kind") == "bounced").alias("bounced"),
        F.bool_or(F.col("kind").isin(*FACES)).alias("replied"),
        F.bool_or(F.col("kind") == "rejected").alias("rejected"),
        F.max(F.when(F.col("kind") == "interview", 2).when(F.col("kind") == "acknowledged", 1).otherwise(0)).alias("rank"),
        F.max("at").alias("last_at"),
        F.count(F.lit(1)).alias("n_events"),
    )
    joined = applications.join(reached, applications.id == reached.app_id, "left")
    state = (
        F.when(F.col("bounced") & ~F.col("replied"), "bounced")
        .when(F.col("rejected"), "rejected")
        .when(F.col("rank") == 2, "interview")
        .when(F.col("rank") == 1, "acknowledged")
        .otherwise("noreply")
    )
    silent = floor_days(today, F.coalesce("last_at", "ts"))
    open_still = F.col("state").isin("noreply", "acknowledged") & (silent >= GHOSTED_DAYS)
    return joined.withColumn("state", state).select(
        "id",
        F.when(open_still, "ghosted").otherwise(F.col("state")).alias("state"),
        floor_days(today, F.col("ts")).alias("days_waiting"),
        F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"),
        "longshot",
    )


STATES = ("bounced", "ghosted", "interview", "rejected", "acknowledged", "noreply")


def tallies(states: DataFrame) -> DataFrame:
    """States counted over all applications and without the long shots, in one pass."""
    real = ~F.coalesce("longshot", F.lit(False))
    counted = [F.count_if(F.col("state") == s).alias(f"{s}_all") for s in STATES]
    counted += [F.count_if((F.col("state") == s) & real).alias(f"{s}_real") for s in STATES]
    return states.agg(F.count(F.lit(1)).alias("applications"), F.count_if(~real).alias("longshots"), *counted,
                      F.count_if(F.col("n_events") > 0).alias("answered"))


def overlay_verdicts(states: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The user's newest verdict over the derived state; of equal times the later line wins."""
    newest = verdicts.filter(F.col("id").isNotNull() & F.col("state").isNotNull()).groupBy(F.col("id").alias("v_id")).agg(
        F.max_by(F.struct("state", "reason"), F.struct(F.coalesce("ts", F.lit(0).cast("timestamp")), "seq")).alias("v")
    )
    joined = states.join(newest, states.id == newest.v_id, "left")
    return joined.select(
        *[c for c in states.columns if c != "state"],
        F.coalesce(F.col("v.state"), F.col("state")).alias("state"),
        F.col("v").isNotNull().alias("decided_by_user"),
        F.coalesce(F.col("v.reason"), F.lit("")).alias("decided_why"),
    )


def stray_states(states: DataFrame) -> DataFrame:
    """States that no report knows, with their number; empty when all is well."""
    return states.filter(~F.col("state").isin(*STATES)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def state_report(states: DataFrame) -> DataFrame:
    """(place, state, n) in report order; interviews always show, other states only if there are any."""
    dim = states.sparkSession.createDataFrame(list(enumerate(("interview", "acknowledged", "noreply", "ghosted", "rejected", "bounced"))), "place int, state string")
    counted = states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(counted, "state", "left").select("place", "state", F.coalesce("n", F.lit(0)).alias("n")).filter("n > 0 OR state = 'interview'")
