"""Tables behind the reports: orders, checks of sums, and notes on what isn't shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.mail import STATES
from quarryline.operators.ordering import numbered

NOTHING, FULL, TOP = "nothing has recurred yet", "to show, but the message is full", "showing the top"


def silence_first(states: DataFrame, silent: tuple[str, ...] = ("noreply", "ghosted")) -> DataFrame:
    """Applications nobody has answered with their place: the longest silence first, an unknown one last."""
    waiting = states.filter(F.col("state").isin(*silent))
    return numbered(waiting, F.desc(F.coalesce("days_waiting", F.lit(-1))), F.col("id"))


def state_cover(states: DataFrame) -> DataFrame:
    """(applications, counted, complete): whether the known states add up to all applications."""
    counted = states.agg(F.count(F.lit(1)).alias("applications"), F.count_if(F.col("state").isin(*STATES)).alias("counted"))
    return counted.withColumn("complete", F.col("applications") == F.col("counted"))


def newest_of(rows: DataFrame, seq: str, most: int = 8) -> DataFrame:
    """The last ``most`` rows in ``seq`` order."""
    return rows.orderBy(F.desc(seq)).limit(most)


def recurrence_notes(store: DataFrame, limits: dict[str, int], cost: Column, budget: int) -> DataFrame:
    """(bucket, shown, every, note) of each bucket of a store of titles, in the order of ``limits``.

    A bucket shows its top titles as long as their costs fit into what the buckets before left of
    the budget. The note says which of three things holds: nothing recurs, nothing fits, or some
    are not shown; it is empty if all are.
    """
    recurring = store.filter("n >= 2")
    counts = {row.bucket: row["count"] for row in recurring.filter(F.col("bucket").isin(*limits)).groupBy("bucket").count().collect()}
    found, room = [], budget
    for bucket, limit in limits.items():
        top = recurring.filter(F.col("bucket") == bucket).orderBy(F.desc("n"), "title", "key").limit(limit)
        shown = 0
        for row in top.select(cost.alias("cost")).collect():  # ``limit`` rows at most
            if row.cost > room:
                break
            room, shown = room - row.cost, shown + 1
        every = counts.get(bucket, 0)
        note = NOTHING if not every else FULL if not shown else TOP if every > shown else ""
        found.append((bucket, shown, every, note))
    return store.sparkSession.createDataFrame(found, "bucket string, shown long, every long, note string")
