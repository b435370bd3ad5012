"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges (16 bytes each) up to which each node's least neighbour is broadcast.
SENT = 200_000


def beside(least: DataFrame, edges: int) -> DataFrame:
    """A side of one row a node for a join with edges, so that a hub's edges need not meet in one task: broadcast if small, else computed apart, which leaves the join plain exchanges whose large partitions Spark can split."""
    return F.broadcast(least) if edges <= SENT else cut(least)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the least node of its component, which it is not) for each node but the roots.

    Each round points every node's larger neighbours, then its smaller ones,
    at its least neighbour, until nothing changes; rounds grow with the
    logarithm of the graph. Nothing but two numbers a round reaches the driver.
    """
    e = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).where("node > root").distinct()
    e, state = cut(e), None
    size = e.count()
    while True:
        # large star: neighbours above a node go to its least neighbour
        both = e.unionByName(e.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("least"))
        e = both.where("root > node").join(beside(least, size), "node").select(F.col("root").alias("node"), F.col("least").alias("root"))
        # small star: a node and its neighbours below go to the least of these
        least = e.groupBy("node").agg(F.min("root").alias("least"))
        near = e.join(beside(least, size), "node")
        e = near.where("root > least").select(F.col("root").alias("node"), F.col("least").alias("root")).unionByName(least.withColumnRenamed("least", "root")).distinct()
        e = cut(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if now == state:
            return e
        state, size = now, now[0]
