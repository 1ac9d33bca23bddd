"""Exact dedup by a heavy-hitter split, in DataFrame operations only.

A Misra-Gries pass over the digests names at most ``1 / support`` candidates that may be
frequent. Their exact counts are verified, and the winners are broadcast: rows of hot
groups get their keeper map-side and are never shuffled. All other digests are shuffled:
the keeper and size of each group are aggregated, map-side first, and groups of two rows or
more are joined back, so that no task holds a group, however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import materialise

SPACE_RUN = r"[\x20\x09-\x0D]+"
#: A digest is hot above this share of the rows; the broadcast has 1 / SUPPORT rows at most.
SUPPORT = 0.001
#: The least of these in a group is its keeper: null ids last, then the row's place in the scan.
KEEP_ORDER = "struct(doc_id IS NULL AS unknown, doc_id, row_no)"


def text_digest(text) -> F.Column:
    """SHA-256 (lowercase hex) of the text with each run of ASCII white space as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "), 256)


def exact_dedup(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and form one group with empty ones. The smallest doc_id of a
    group stays; null ids come last. Of repeated rows (same id and text) exactly one stays.
    An empty table gives no rows; further columns of ``docs`` are not read, whatever their names.
    Texts of any length are read whole; only their digests are shuffled.
    """
    digests = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("text_sha256")
        ).withColumn("row_no", F.monotonically_increasing_id())
    )
    hot = F.broadcast(materialise(hot_groups(digests, support)))
    tagged = digests.join(hot, "text_sha256", "left")
    first = F.col("keeper")
    heavy = tagged.filter(first.isNotNull()).select(
        "doc_id",
        first["doc_id"].alias("keep_id"),
        F.col("hot_size").alias("group_size"),
        (F.col("row_no") == first["row_no"]).alias("kept"),
        "text_sha256",
    )
    rest = tagged.filter(first.isNull()).select("doc_id", "row_no", "text_sha256")
    repeated = materialise(
        rest.groupBy("text_sha256")
        .agg(F.min(F.expr(KEEP_ORDER)).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    light = rest.join(repeated, "text_sha256", "left").select(
        "doc_id",
        F.when(first.isNull(), F.col("doc_id")).otherwise(first["doc_id"]).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row_no") == first["row_no"], F.lit(True)).alias("kept"),
        "text_sha256",
    )
    return heavy.unionByName(light)


def hot_groups(digests: DataFrame, support: float) -> DataFrame:
    """Digests that verifiably hold at least ``support`` of the rows, with their keeper and size."""
    least = max(2.0, digests.count() * support)
    candidates = digests.freqItems(["text_sha256"], support).select(
        F.explode("text_sha256_freqItems").alias("text_sha256")
    )
    return (
        digests.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.min(F.expr(KEEP_ORDER)).alias("keeper"), F.count(F.lit(1)).alias("hot_size"))
        .filter(F.col("hot_size") >= least)
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever their names.

    Rows are chosen by id and digest. Only rows whose id repeats with an equal text are grouped,
    so that one of them stays.
    """
    verdicts = materialise(exact_dedup(docs, support))
    same = verdicts.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("q_kept"), F.count(F.lit(1)).alias("q_rows")
    )
    kept = materialise(
        same.filter("q_kept").select(F.col("doc_id").alias("q_id"), F.col("text_sha256").alias("q_digest"), "q_rows")
    )
    digested = docs.select(
        F.col("doc_id").cast("long").alias("own_id"), text_digest(F.col("text")).alias("own_digest"), F.struct("*").alias("whole")
    )
    match = F.col("own_id").eqNullSafe(F.col("q_id")) & (F.col("own_digest") == F.col("q_digest"))
    once = digested.join(kept.filter("q_rows = 1"), match, "left_semi")
    again = digested.join(kept.filter("q_rows > 1"), match, "left_semi").dropDuplicates(["own_id", "own_digest"])
    return once.unionByName(again).select("whole.*")


EXACT_DEDUP_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
