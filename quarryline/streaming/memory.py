"""Keyed memory of streams, with expiry: what was seen, and what keeps being dropped.

State is a few values for each key, on the executor that owns it; a key that is not met for its time
is forgotten by a timer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quarryline.operators.discover import STALE_DAYS, drop_bucket, title_key

DAY_MS = 86_400_000


def milliseconds(times: pd.Series) -> int:
    """The latest of some times, in milliseconds; nought of none."""
    latest = times.max()
    return 0 if pd.isna(latest) else int(pd.Timestamp(latest).timestamp() * 1000)


def unseen_stream(rows: DataFrame, key: str, seq: str, at: str | None = None, ttl_ms: int | None = None) -> DataFrame:
    """The rows of a stream whose key was not in it before: of each key the one of the least ``seq`` in its first batch.

    Rows without a key are not held against any other and pass. Memory is one key each, for ever or, with a
    watermark on the time ``at``, until that is ``ttl_ms`` after the key was last met. Columns come with ``seq`` first.
    """
    columns = [seq, *[c for c in rows.columns if c != seq]]
    schema = StructType([rows.schema[c] for c in columns])

    def step(_, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        fresh, first, last = not state.exists, None, 0
        for batch in batches:
            last = max(last, milliseconds(batch[at])) if ttl_ms else 0
            if fresh and len(batch):
                least = batch.sort_values(seq, kind="stable").head(1)
                first = least if first is None or least[seq].iloc[0] < first[seq].iloc[0] else first
        state.update((True,))
        if ttl_ms:
            state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs() + 1))
        if first is not None:
            yield first[columns]

    timeout = GroupStateTimeout.EventTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    keyed = rows.filter(F.col(key).isNotNull()).groupBy(key)
    first = keyed.applyInPandasWithState(step, schema, "seen boolean", "append", timeout)
    return first.unionByName(rows.filter(F.col(key).isNull()).select(*columns))


STORE = "key string, title string, why string, bucket string, n long, first date, last date"


def recurrence_stream(drops: DataFrame, stale_days: int = STALE_DAYS, watermark: str = "2 days") -> DataFrame:
    """The store rows that change with each batch of drops (title, why, bucket, seq, day), as updates by key.

    First spelling and date stay, the latest reason wins, every drop counts. A title that has not been
    dropped for ``stale_days`` is forgotten by a timer, unless a drop comes in the batch that passes it. Drops that
    are later than the ``watermark`` allows are left out. The newest
    update of each key is what ``merge_drops`` makes of all drops so far.
    """
    rows = drops.select(
        title_key(F.col("title")).alias("key"), "title", F.coalesce("why", F.lit("")).alias("why"), F.coalesce("bucket", drop_bucket(F.col("why"))).alias("bucket"),
        F.col("seq").cast("long").alias("seq"), F.unix_date("day").cast("long").alias("day"),
        F.col("day").cast("timestamp").alias("at"),
    ).filter("key <> '' AND day IS NOT NULL")

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        found = pd.concat(list(batches)).sort_values("seq", kind="stable")
        kept, last = state.get if state.exists else None, found.iloc[-1]
        title, day, n = (found.iloc[0]["title"], int(found.iloc[0]["day"]), 0) if kept is None else (kept[0], kept[4], kept[3])
        state.update((title, last["why"], last["bucket"], n + len(found), day, int(last["day"])))
        state.setTimeoutTimestamp(max((int(last["day"]) + stale_days + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        dates = [pd.Timestamp(d, unit="D").date() for d in (day, int(last["day"]))]
        yield pd.DataFrame({"key": [key[0]], "title": [title], "why": [last["why"]], "bucket": [last["bucket"]], "n": [n + len(found)], "first": [dates[0]], "last": [dates[1]]})

    kept = "title string, why string, bucket string, n long, first long, last long"
    return rows.withWatermark("at", watermark).groupBy("key").applyInPandasWithState(step, STORE, kept, "update", GroupStateTimeout.EventTimeTimeout)
