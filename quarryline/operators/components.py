"""Connected components of a large edge table by alternating star contraction."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.session import materialise, ship_package


#: Edges that one task joins up before they are shuffled.
TASK_EDGES = 300_000


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long edges to one row (node, root) per node that has an edge; root is the least node.

    Edges are joined up where they are first, ``TASK_EDGES`` in a task, which leaves one edge for each
    node of a task. One task's worth of them is done by then. Of more, each round links every node's
    larger neighbours to its least one, then its smaller ones, which shortens paths and never adds edges;
    it ends when every node but the roots has one edge, to a root, and rounds grow with the logarithm of
    the longest path. Every round is checkpointed, and what it shuffled is let go. Loops (u = v) are
    ignored; edges may repeat; no edges give no rows.
    """
    ship_package(edges.sparkSession)
    given = materialise(edges.select("u", "v").filter("u <> v"))
    tasks = max(1, -(-given.count() // TASK_EDGES))
    current = materialise(given.coalesce(tasks).mapInArrow(joined_up, "u long, v long"))
    let_go(current.sparkSession)
    while tasks > 1 and not of_stars(current):
        current = contracted(current)
        let_go(current.sparkSession)
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined_up(batches):
    """An edge from each node of a task's edges to the least one that it is linked to by them."""
    above: dict[int, int] = {}

    def root(node: int) -> int:
        while (up := above.get(node, node)) != node:
            above[node] = node = above.get(up, up)
        return node

    for batch in batches:
        for one, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            one, other = root(one), root(other)
            if one != other:
                above[max(one, other)] = min(one, other)
    nodes = list(above)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(map(root, part), pa.int64())], names=["u", "v"])


def contracted(current: DataFrame) -> DataFrame:
    """One round: larger neighbours to the least one of each node, then smaller ones."""
    both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lower = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return materialise(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())


def of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if an edge comes down to it."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("met"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("met")))
    counted = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("met").alias("met"))
    return counted.filter("down > 1 OR (down > 0 AND met > 0)").isEmpty()


def let_go(spark: SparkSession) -> None:
    """Have executors delete the shuffle files and checkpoints that nothing refers to any more.

    They go when the driver's garbage is collected, which it otherwise puts off for half an hour
    while many small shuffles fill the disks.
    """
    gc.collect()
    spark._jvm.System.gc()
