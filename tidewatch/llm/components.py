"""Distributed union-find: connected components by alternating stars.

Only DataFrame operations. Each round writes its edges to the shared folder, so plans stay
short and a lost executor costs one round at most. The edges of a round are removed when those of
the next are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove
from .common import stored_at


def _lower(edges: DataFrame, both: bool) -> DataFrame:
    """Points every node at the least node of its neighbourhood.

    both: the neighbours above it follow it there (large star), else those below (small
    star). A hub's rows are joined with its one minimum, a join whose hot partitions Spark splits.
    """
    if both:
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges
    least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = around.join(least, "a")
    if both:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.distinct()
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select("a", F.col("m").alias("b"))
    )
    return moved.where("a > b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node with an edge downwards has one, to a node without: another round would change nothing."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("up"))
    return nodes.where("ups > 1 or ups = 1 and up = 0").limit(1).count() == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge.

    edges: columns a and b of one integer type; order, direction, repeats and loops don't
    matter, rows with a null are no edges. Returns node and component, the least node
    reachable. No edges give no rows. Raises if it has not settled after max_rounds.
    """
    a, b = F.col("a"), F.col("b")
    current, path = stored_at(
        edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if _settled(current):
            break
        old = path
        current, path = stored_at(_lower(_lower(current, True), False), "edges")
        remove(edges.sparkSession, old)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
