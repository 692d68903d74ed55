"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _least(edges: DataFrame, own: bool) -> DataFrame:
    """(a, m, n): each node's least neighbour (or itself with ``own``), and how many it has (n).

    It is summed before the shuffle and written, so that the join with it can split the
    edges of a hub, as no aggregate is left in its way.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    least = least.select("a", F.least("a", "m").alias("m"), "n") if own else least
    return materialise(least)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both, True).select("a", "m"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down, False)
    moved = down.join(least.where("n > 1").select("a", "m"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b: long); a component is its least node.

    Each round goes to the shared folder; the driver sees two numbers of it. Loops and
    repeated edges don't matter. The number of rounds grows with the logarithm of a
    component's size.
    """
    edges = materialise(edges.where("a != b").select("a", "b").distinct())
    was = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == was or now[0] == 0:
            break
        was = now
        edges = materialise(_small_star(materialise(_large_star(edges))))
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
