"""Numbers and running sums in an order over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.session import materialise

#: Bits of a row's place within its partition in what monotonically_increasing_id gives.
PLACE_BITS = 33


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """``rows`` with ``name``: their place, from 1, in ``order``.

    Rows are dealt to ranges of the order by sampled bounds, so no key or gap fills one task, and
    sorted within them; each range starts after the rows of those before it. Only the counts of
    ranges, a row each, are summed in one task. Rows that are equal in ``order`` stay together.
    """
    dealt = rows.select("*", F.struct("*").alias("q_row")).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialise(dealt.select(F.col("q_row").alias("row"), F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", PLACE_BITS)
    counts = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(counts.select("part", F.coalesce(before, F.lit(0)).alias("before")))
    inside = F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1
    return dealt.withColumn("part", part).join(starts, "part").select("row.*", (F.col("before") + inside).alias(name))


def running(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], size: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``size`` over the rows of the same ``by`` up to this one, in ``order``.

    Rows are dealt to ranges of keys and order, so one key may fill any number of them. Sums are taken
    within each range and key; what a key has in the ranges before, a row for each of both, is summed
    by key. ``order`` must not repeat within a key; null keys are equal, null sizes are nought.
    """
    packed = rows.select(*[F.col(c).alias(f"q_{c}") for c in {*by, *order}], F.coalesce(size, F.lit(0)).alias("q_size"), F.struct("*").alias("q_row"))
    keys = [F.col(f"q_{c}") for c in (*by, *order)]
    dealt = packed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = materialise(dealt.withColumn("q_at", F.monotonically_increasing_id())).withColumn("q_part", F.shiftright("q_at", PLACE_BITS))
    mine = [f"q_{c}" for c in by]
    inside = Window.partitionBy(*mine, "q_part").orderBy("q_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.groupBy(*mine, "q_part").agg(F.sum("q_size").alias("held"))
    before = F.sum("held").over(Window.partitionBy(*mine).orderBy("q_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*[F.col(c).alias(f"s_{c}") for c in mine], F.col("q_part").alias("s_part"), F.coalesce(before, F.lit(0)).alias("before"))
    same = F.col("q_part") == F.col("s_part")
    for c in mine:
        same = same & F.col(c).eqNullSafe(F.col(f"s_{c}"))
    summed = dealt.withColumn("q_inside", F.sum("q_size").over(inside)).join(starts, same)
    return summed.select("q_row.*", (F.col("before") + F.col("q_inside")).alias(name))
