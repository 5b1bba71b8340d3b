"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Move edges (a > b) of every node to the least node around it: those to larger nodes, or those to smaller ones.

    The least neighbour is found by an aggregate that is partial before the shuffle, and joined back: a node
    with a third of all edges is never in one group.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        joined = edges.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").union(least.select("a", F.col("least").alias("b")))
    return moved.distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and component (the least node reachable) of every node that a link (a, b) touches.

    Links may be in any direction and repeated; links of a node to itself are left out. Each round is
    written to the shared folder. No node, link or component goes to the driver, only a count and a sum.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    seen = None
    for _ in range(rounds):
        edges = stored(_star(_star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
