"""The offer ledger: ids, history, decisions, and the guards around what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.ordering import numbered
from quarryline.session import materialise


def high_water(*ids: DataFrame) -> DataFrame:
    """(hwm): the largest positive id in any of the given one-column tables; 0 if there is none."""
    together = ids[0].select(F.col(ids[0].columns[0]).cast("long").alias("id"))
    for other in ids[1:]:
        together = together.unionByName(other.select(F.col(other.columns[0]).cast("long").alias("id")))
    return together.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(0)).alias("hwm"))


def assign_ids(rows: DataFrame, seq: str, hwm: DataFrame) -> DataFrame:
    """``rows`` with ``id``: consecutive numbers in ``seq`` order after the high-water mark. ``seq`` is unique."""
    placed = numbered(rows, seq, name="q_place").crossJoin(F.broadcast(hwm))
    return placed.select(*rows.columns, (F.col("hwm") + F.col("q_place")).alias("id"))


def unknown_only(rows: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """Rows whose key the history does not have; rows with a null key stay."""
    known = history.select(F.col(key)).filter(F.col(key).isNotNull()).distinct()
    return rows.join(known, key, "left_anti").select(*rows.columns)


def without(rows: DataFrame, gone: DataFrame, *identity: str) -> DataFrame:
    """Rows minus those with exactly the same identity columns, nulls equal."""
    names = [f"gone_{c}" for c in identity]
    other = gone.select(*[F.col(c).alias(n) for c, n in zip(identity, names, strict=True)]).distinct()
    same = F.lit(True)
    for column, name in zip(identity, names, strict=True):
        same &= F.col(column).eqNullSafe(F.col(name))
    return rows.join(other, same, "left_anti")


def outage(pending: Column, dead: Column) -> Column:
    """Too many dead at once to be believed: five and half of all, or all of three and more."""
    half = (dead >= 5) & (dead >= F.ceil(pending / 2))
    return half | ((dead == pending) & (dead >= 3))


def mark_seen(pending: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending rows with those in ``ids`` checked and marked as the user's decision."""
    asked = ids.select(F.col("id").alias("asked_id")).filter("asked_id IS NOT NULL").distinct()
    joined = pending.join(asked, F.col("id") == F.col("asked_id"), "left")
    hit = F.col("asked_id").isNotNull() & ~F.col("checked")
    return joined.select(
        *[c for c in pending.columns if c not in ("checked", "by_user")],
        (F.col("checked") | hit).alias("checked"),
        (F.col("by_user") | hit).alias("by_user"),
    )


def missing_ids(pending: DataFrame, ids: DataFrame) -> DataFrame:
    """Asked ids that are no open row."""
    opened = pending.filter("NOT checked").select("id")
    return ids.select("id").filter("id IS NOT NULL").distinct().join(opened, "id", "left_anti")


def restore(pending: DataFrame, item: int) -> DataFrame:
    """Undo a mark, if it was the user's."""
    undone = (F.col("id") == item) & F.col("by_user")
    return pending.withColumns({
        "checked": F.col("checked") & ~F.coalesce(undone, F.lit(False)),
        "by_user": F.col("by_user") & ~F.coalesce(undone, F.lit(False)),
    })


def remove_one(journal: DataFrame, item: int, seq: str = "seq", at: str | None = None) -> DataFrame:
    """The journal without one record of an id: that with the given ``ts``, or else its last."""
    match = F.col("id") == item
    if at is not None:
        match &= F.col("ts") == F.lit(at).cast("timestamp")
    last = journal.filter(match).agg(F.max(seq).alias("gone_seq"))
    return journal.join(F.broadcast(last), F.col(seq) == F.col("gone_seq"), "left_anti")


def checked_rewrite(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, materialised; refuses to lose rows that ``old`` had."""
    new = materialise(new)
    had, has = old.count(), new.count()
    if has < had:
        raise ValueError(f"the rewrite would shrink the journal from {had} to {has} rows")
    return new


def history_rows(offers: DataFrame, day: Column) -> DataFrame:
    """Offers as rows of the scan history."""
    status = F.when(F.col("stage") == "ADMITTED", "added").when(F.col("stage") == "DUPLICATE", "dup").otherwise("filtered")
    return offers.select("url", day.alias("first_seen"), F.col("source").alias("portal"), "title", "company", status.alias("status"), "location")


def file_names(company: Column, owner: str) -> Column:
    """A letter's file name: owner and company in capitalised words, letters and digits only, 40 characters."""
    words = F.filter(F.split(company, r"[^\p{L}\p{Nd}]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))), "")
    return F.left(F.concat(F.lit(owner + "_"), joined), F.lit(40))


def unique_names(rows: DataFrame, base: str, seq: str) -> DataFrame:
    """Names with _2, _3, ... for later rows of the same base."""
    place = F.row_number().over(Window.partitionBy(base).orderBy(seq))
    named = F.when(F.col("place") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("place").cast("string")))
    return rows.withColumn("place", place).withColumn("name", named).drop("place")
