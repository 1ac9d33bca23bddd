"""Set operations on lists of labels and ids, compared in folded form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import fold


def without(rows: DataFrame, column: str, *others: DataFrame, folded: bool = True) -> DataFrame:
    """Rows whose ``column`` none of the others (one column each) has; nulls stay, as they equal nothing."""
    form = (lambda c: fold(c)) if folded else (lambda c: F.col(c))
    known = [other.select(form(other.columns[0]).alias("q_known")).filter(F.col(other.columns[0]).isNotNull()) for other in others]
    if not known:
        return rows
    keyed = rows.withColumn("q_key", F.when(F.col(column).isNotNull(), form(column)))
    return keyed.join(reduce(DataFrame.unionByName, known).distinct(), F.col("q_key") == F.col("q_known"), "left_anti").select(*rows.columns)


def together(*lists: DataFrame) -> DataFrame:
    """(label): the labels of all lists (one column each), of those that fold alike the first of the first list. Empty ones go."""
    placed = [x.select(F.col(x.columns[0]).alias("label"), F.lit(i).alias("place")) for i, x in enumerate(lists)]
    rows = reduce(DataFrame.unionByName, placed).filter(F.trim("label") != "")
    return rows.groupBy(fold(F.trim("label")).alias("q_key")).agg(F.min(F.struct("place", "label"))["label"].alias("label")).select("label")
