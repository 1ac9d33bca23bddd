"""Ordered dedup over two keys."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.operators.components import connected_components
from quarryline.session import materialise


#: Rows that wait for each other are walked by one task up to this number.
TASK_ROWS = 1_000_000


def greedy_two_key(rows: DataFrame, first: str, second: str, seq: str, newest: bool = False) -> DataFrame:
    """Rows that a walk in ``seq`` order keeps: those of which no kept row before has either key.

    Null keys equal nothing. ``newest`` walks backwards. ``seq`` must be unique.

    A row that is first among all on both of its keys is kept, and those that share a key with it are
    dropped; that decides all but a few. The rest wait for each other in chains. Keys that a row links
    are one component, and components are walked in order, many in a task, each by one. Only of
    components of more than ``TASK_ROWS`` are rows decided in rounds again, as many as their longest
    chain. Minima are combined before they are shuffled, so a hot key costs one row a task.
    """
    order = -F.col(seq).cast("long") if newest else F.col(seq).cast("long")
    open_rows = materialise(rows.select(F.col(first).alias("k1"), F.col(second).alias("k2"), order.alias("at")))
    kept, waiting = first_of_both(open_rows)
    if not waiting.isEmpty():
        labelled = with_component(waiting)
        large = materialise(labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TASK_ROWS).select("component"))
        kept = kept.unionByName(walked(labelled.join(large, "component", "left_anti")))
        waiting = materialise(labelled.join(large, "component", "left_semi").select("k1", "k2", "at"))
        while not waiting.isEmpty():
            more, waiting = first_of_both(waiting)
            kept = kept.unionByName(more)
    kept_seq = materialise(kept).select((-F.col("at") if newest else F.col("at")).alias("kept_seq"))
    return rows.join(kept_seq, F.col(seq).cast("long") == F.col("kept_seq"), "left_semi")


def first_of_both(open_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(at) of the rows that come first on both of their keys, and the rows that share no key with them."""
    marked = open_rows
    for key in ("k1", "k2"):
        least = open_rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("at").alias(f"least_{key}"))
        marked = by_key(marked, least, key, "left")
    mine = F.col("at")
    wins = (mine == F.coalesce("least_k1", mine)) & (mine == F.coalesce("least_k2", mine))
    marked = materialise(marked.select("k1", "k2", "at", wins.alias("wins")))
    winners, rest = marked.filter("wins"), marked.filter("NOT wins").select("k1", "k2", "at")
    for key in ("k1", "k2"):
        taken = winners.select(key).filter(F.col(key).isNotNull()).distinct()
        rest = by_key(rest, taken, key, "left_anti").select("k1", "k2", "at")
    return winners.select("at"), materialise(rest)


def with_component(rows: DataFrame) -> DataFrame:
    """``rows`` with ``component``: the least of all keys that rows link to theirs. Keys that share a hash only make it larger."""
    hashed = rows.withColumns({"h1": F.when(F.col("k1").isNotNull(), F.xxhash64(F.lit(1), "k1")), "h2": F.when(F.col("k2").isNotNull(), F.xxhash64(F.lit(2), "k2"))})
    roots = connected_components(hashed.filter("h1 IS NOT NULL AND h2 IS NOT NULL").select(F.col("h1").alias("u"), F.col("h2").alias("v")))
    met = hashed.withColumn("node", F.coalesce("h1", "h2")).join(roots, "node", "left")
    return materialise(met.select("k1", "k2", "at", F.coalesce("root", "node").alias("component")))


def walked(labelled: DataFrame) -> DataFrame:
    """(at) of the rows that a walk through each component keeps."""

    def run(batches):
        current, seen = None, (set(), set())
        for batch in batches:
            kept = []
            for component, at, *keys in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if component != current:
                    current, seen = component, (set(), set())
                if all(key is None or key not in known for key, known in zip(keys, seen, strict=True)):
                    kept.append(at)
                    for key, known in zip(keys, seen, strict=True):
                        known.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["at"])

    ordered = labelled.select("component", "at", "k1", "k2").repartition("component").sortWithinPartitions("component", "at")
    return ordered.mapInArrow(run, "at long")


def by_key(rows: DataFrame, other: DataFrame, key: str, how: str) -> DataFrame:
    """A join whose rows without a key, which match nothing, stay where they are."""
    joined = rows.filter(F.col(key).isNotNull()).join(other, key, how)
    return joined.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True)


def last_wins(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the values of its last row, at the place (``first_seq``) of its first."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    folded = rows.groupBy(F.col(key).alias("group_key")).agg(F.max_by(whole, F.col(seq)).alias("row"), F.min(seq).alias("first_seq"))
    return folded.select("row.*", "first_seq")


def first_of_family(rows: DataFrame, family: str, *order) -> DataFrame:
    """The first row of each family."""
    place = F.row_number().over(Window.partitionBy(family).orderBy(*order))
    return rows.withColumn("q_place", place).filter("q_place = 1").drop("q_place")
