"""Reviews: a log of taps replayed over a snapshot of offers, with undo as a tombstone of one decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.dedup import last_wins
from quarryline.operators.stretches import Cursor, walk

DECISIONS = ("seen", "no", "applied")
#: Where the record of a decision is kept; a seen offer has none.
JOURNALS = {"no": "feedback", "applied": "applications"}


class Standing:
    """Of decisions and undos of one offer: the number of the decision that stands, if any.

    A second decision is ignored, an undo takes the standing one away. Rows are (number, action); the
    value is the number of the decision that was recorded or undone, null if nothing happened.
    """

    columns = ("seq", "action")

    def start(self):
        return None

    def step(self, state, row):
        seq, action = row
        if action == "undo":
            return None, state
        return (seq, seq) if state is None else (state, None)

    def summary(self, rows):
        state = None
        for row in rows:
            state, _ = self.step(state, row)
        return [state, any(action == "undo" for _, action in rows)]

    def after(self, summary, state):
        left, undone = summary
        if state is None or not undone:
            return left if state is None else state
        return left


def replayed(deck: DataFrame, taps: DataFrame) -> DataFrame:
    """(deck, seq, action, place, offer_id, effect, about) of the taps of a review.

    ``deck`` (deck, place from 0, offer_id) is the snapshot, in which decided offers stay; ``taps`` are
    (deck, seq, action, offer_id): prev and next move a cursor that stays within the deck, ``cur``
    does nothing, seen, no and applied decide about the offer under the cursor, and undo takes the
    decision about it back. A tap with an offer_id of the deck is about that one. Effects are moved,
    none, recorded, ignored (decided already), undone, and nothing (no decision to undo); ``about`` is
    the decision that is recorded or undone. Taps of decks without offers are outdated and go.
    """
    sizes = deck.groupBy(F.col("deck").alias("s_deck")).agg((F.count(F.lit(1)) - 1).alias("last"))
    move = F.when(F.col("action") == "next", 1).when(F.col("action") == "prev", -1).otherwise(0)
    known = taps.join(sizes, F.col("deck") == F.col("s_deck")).select("deck", "seq", "action", F.col("offer_id").alias("named"), move.cast("long").alias("move"), "last")
    placed = walk(known, "deck", ("seq",), Cursor(("move", "last")), "place", "long").drop("move", "last")
    cards = deck.select(F.col("deck").alias("c_deck"), F.col("place").alias("c_place"), F.col("offer_id").alias("shown"))
    met = placed.join(cards, (F.col("deck") == F.col("c_deck")) & (F.col("place") == F.col("c_place")))
    met = met.select("deck", "seq", "action", "place", F.coalesce("named", "shown").alias("offer_id"))
    acting = F.col("action").isin(*DECISIONS, "undo")
    told = walk(met.filter(acting).withColumn("card", F.struct("deck", "offer_id")), "card", ("seq",), Standing(), "about", "long").drop("card")
    effect = (
        F.when((F.col("action") == "undo") & F.col("about").isNotNull(), "undone").when(F.col("action") == "undo", "nothing")
        .when(F.col("about").isNotNull(), "recorded").otherwise("ignored")
    )
    still = met.filter(~acting).withColumns({"effect": F.when(F.col("action").isin("prev", "next"), "moved").otherwise("none"), "about": F.lit(None).cast("long")})
    return told.withColumn("effect", effect).select(*still.columns).unionByName(still)


def decisions(log: DataFrame) -> DataFrame:
    """(deck, offer_id, action, seq, journal, undone) of all recorded decisions; tombstones mark those that were undone."""
    gone = log.filter("effect = 'undone'").select(F.col("deck").alias("g_deck"), F.col("about").alias("g_seq"), F.lit(True).alias("undone"))
    journal = F.lit(None).cast("string")
    for action, name in JOURNALS.items():
        journal = F.when(F.col("action") == action, name).otherwise(journal)
    kept = log.filter("effect = 'recorded'").join(gone, (F.col("deck") == F.col("g_deck")) & (F.col("seq") == F.col("g_seq")), "left")
    return kept.select("deck", "offer_id", "action", "seq", journal.alias("journal"), F.coalesce("undone", F.lit(False)).alias("undone"))


def after_review(deck: DataFrame, log: DataFrame) -> DataFrame:
    """(deck, offer_id, decision): the decision that stands about each offer of the snapshot, null if it is pending (again)."""
    standing = decisions(log).filter("NOT undone").select(F.col("deck").alias("d_deck"), F.col("offer_id").alias("d_offer"), F.col("action").alias("decision"))
    met = deck.join(standing, (F.col("deck") == F.col("d_deck")) & (F.col("offer_id") == F.col("d_offer")), "left")
    return met.select("deck", "offer_id", "decision")


def state_records(commands: DataFrame, applications: DataFrame) -> DataFrame:
    """(seq, id, state, reason, title, company, known) of commands (seq, id, state, reason) on applications (id, title, company, seq).

    Of several applications with an id the last one is meant. A command on none records nothing
    (``known`` is false).
    """
    last = last_wins(applications.select("id", "title", "company", "seq"), "id", "seq").select(F.col("id").alias("a_id"), "title", "company")
    met = commands.join(last, F.col("id") == F.col("a_id"), "left")
    return met.select("seq", "id", "state", F.coalesce("reason", F.lit("")).alias("reason"), "title", "company", F.col("a_id").isNotNull().alias("known"))
