"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours of each node (the larger, or the smaller ones and itself) at its least neighbour."""
    if large:
        around = edges.union(edges.select("b", "a"))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    joined = around.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    ``edges`` has columns a, b of one orderable type, in any direction, and
    may repeat or hold loops.  Rounds grow with the logarithm of the number
    of nodes; each is cut off by a written table.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
        now = written(_star(_star(now, large=True), large=False), "edges")
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())
