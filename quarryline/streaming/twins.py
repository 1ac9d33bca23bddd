"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarryline.operators.stretches import Gate, walk

COMMANDS = (
    ("seen", r"^seen((?:\s+#?\d+)+)\s*$"),
    ("applied", r"^applied\s+#?(\d+)\s*$"),
    ("longshot", r"^longshot\s+#?(\d+)(?:\s[\s\S]*)?$"),
    ("interview", r"^interview\s+#?(\d+)(?:\s[\s\S]*)?$"),
    ("reject", r"^no\s+#?(\d+)(?:\s[\s\S]*)?$"),
    ("reject_which", r"^no(?:\s[\s\S]*)?$"),
    ("undo", r"^undo(?:\s+#?(\d+))?\s*$"),
    ("cover", r"^cover\s+#?(\d+)\s*$"),
    ("list", r"^(list)\s*$"),
    ("search", r"^(search|scan)\s*$"),
    ("mail", r"^(mail|status)\s*$"),
    ("blind", r"^(blind)\s*$"),
    ("review", r"^(review)\s*$"),
    ("settings", r"^(settings)\s*$"),
    ("help", r"^/?(help|start)(?:\s[\s\S]*)?$"),
)


def command(text: Column) -> Column:
    """(command, ids, note) of a message; the first form that fits decides, none gives ``unknown``. Notes may have many lines."""
    line = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    name = F.lit("unknown")
    for verb, pattern in reversed(COMMANDS):
        name = F.when(line.rlike(pattern), verb).otherwise(name)
    numbered = name.isin("seen", "applied", "longshot", "interview", "reject", "undo", "cover")
    digits = F.regexp_extract(line, r"^\w+((?:\s+#?\d+)*)", 1)
    ids = F.transform(F.regexp_extract_all(digits, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    note = F.trim(F.regexp_extract(F.trim(text), r"^\S+(?:\s+#?\d+)*\s*([\s\S]*)$", 1))
    return F.struct(
        name.alias("command"),
        F.when(numbered, F.array_distinct(ids)).otherwise(F.array().cast("array<bigint>")).alias("ids"),
        F.when(name.isin("longshot", "interview", "reject", "reject_which"), note).otherwise("").alias("note"),
    )


def decisions_once(updates: DataFrame, path: str, checkpoint: str, delay: str = "7 days"):
    """Commands of a stream of updates (update_id, ts, text), each written once although batches may repeat."""
    parsed = updates.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["update_id"])
    rows = parsed.select("update_id", "ts", command(F.col("text")).alias("c")).select("update_id", "ts", "c.*")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def replies_within(applications: DataFrame, replies: DataFrame, lag: str = "2 days", wait: str = "30 days", watermark: str = "3 days") -> DataFrame:
    """Interval join of two streams: replies from ``lag`` before an application to ``wait`` after it."""
    a = applications.select(F.col("app_id"), F.col("ts").alias("applied")).withWatermark("applied", watermark)
    r = replies.select(F.col("app_id").alias("reply_app"), "kind", F.col("at").alias("replied")).withWatermark("replied", watermark)
    near = F.expr(f"reply_app = app_id AND replied >= applied - INTERVAL {lag} AND replied <= applied + INTERVAL {wait}")
    return a.join(r, near).select("app_id", "applied", "kind", "replied")


def ghosted_stream(events: DataFrame, days: int = 60, watermark: str = "1 day") -> DataFrame:
    """(app_id, last_at, state) from events (app_id, kind, at): an application that stays silent turns ghosted.

    One timer per application, set to its last event plus ``days``; an interview or a rejection
    ends it without one. State is a few bytes per open application.
    """

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            last, _ = state.get
            state.remove()
            yield pd.DataFrame({"app_id": [key[0]], "last_at": [pd.Timestamp(last, unit="ms")], "state": ["ghosted"]})
            return
        last, closed = state.get if state.exists else (0, "")
        for batch in batches:
            stamps = batch["at"].astype("int64") // (10**6 if str(batch["at"].dtype).endswith("[ns]") or "ns" in str(batch["at"].dtype) else 10**3)
            last = max(last, int(stamps.max()))
            for kind in ("interview", "rejected"):
                if (batch["kind"] == kind).any():
                    closed = kind
        if closed:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"app_id": [key[0]], "last_at": [pd.Timestamp(last, unit="ms")], "state": [closed]})
            return
        state.update((last, closed))
        due = last + days * 86_400_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("at", watermark).groupBy("app_id").applyInPandasWithState(
        step, "app_id long, last_at timestamp, state string", "last long, closed string", "append", GroupStateTimeout.EventTimeTimeout
    )


def merge_each_batch(merge: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]):
    """A foreachBatch function that merges a batch into a store; ``write`` gets the batch number to stay idempotent."""

    def run(batch: DataFrame, number: int) -> None:
        write(merge(read(), batch), number)

    return run


def cadence_runs(wanted: DataFrame, key: str, order: tuple[str, ...], at: str, every_ms: int) -> DataFrame:
    """``wanted`` with ``ran``: whether the gate of its key lets a run through, ``every_ms`` or more after the last one.

    A time before the last one (a clock that was set back) resets the gate.
    """
    return walk(wanted, key, order, Gate(every_ms, (at,)), "ran", "boolean")


def cooled_down(now: Column, refused_at: Column, cooldown_ms: int) -> Column:
    """A refusal rests a source for ``cooldown_ms``; one that lies in the future does not count."""
    return refused_at.isNull() | (refused_at > now) | (now - refused_at >= cooldown_ms)
