"""Trees as tables of (node, parent)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialise


def follow(rows: DataFrame, to: DataFrame, keys: list[str], many: int = 10_000) -> DataFrame:
    """``rows`` left-joined to ``to``, where a key stands once; the last of ``keys`` may be null in ``rows``.

    A parent of very many children is one key: those of over ``many`` rows, few for that, are sent to the rows,
    so that no task gets all children of one parent. Rows of a null key are not moved either.
    """
    # keys are counted and told apart by a hash of eight bytes: where two share one, both are sent
    hashed = lambda df: df.withColumn("__hash", F.xxhash64(*keys))
    found = rows.where(F.col(keys[-1]).isNotNull())
    hot = materialise(found.groupBy(F.xxhash64(*keys).alias("__hash")).agg(F.count("*").alias("n")).where(F.col("n") > many).select("__hash"))
    if hot.isEmpty():
        met = found.join(to, keys, "left")
    else:
        few = F.broadcast(hashed(to).join(F.broadcast(hot), "__hash", "left_semi").drop("__hash"))
        cold, warm = (hashed(found).join(F.broadcast(hot), "__hash", how).drop("__hash") for how in ("left_anti", "left_semi"))
        met = cold.join(to, keys, "left").unionByName(warm.join(few, keys, "left"))
    return met.unionByName(rows.where(F.col(keys[-1]).isNull()), allowMissingColumns=True)


def climb(edges: DataFrame, many: int = 10_000) -> DataFrame:
    """(node, root, depth) of ``edges`` (node, parent; null at a root), by doubling the steps of all nodes at once.

    Nodes on or below a cycle, and below a missing parent, have a null root. The rounds are
    as many as the logarithm of the greatest depth: a node of twice a depth that no node has lies
    on or below a cycle, so a round that brings no node to its end is the last.
    """
    known = edges.select(F.col("node").alias("parent"), F.lit(True).alias("there"), F.col("parent").isNull().alias("top"))
    met = follow(edges, known, ["parent"], many)
    # a child of a root has climbed: were it left to the rounds, all nodes would meet at the few roots in the last
    climbs = F.col("there") & ~F.col("top")
    step = materialise(met.select(
        "node", F.when(climbs, F.col("parent")).alias("next"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"),
        F.when(F.col("parent").isNull(), F.col("node")).when(F.col("top"), F.col("parent")).alias("root"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost"),
    ))
    done, open_ = step.where("next IS NULL"), step.where("next IS NOT NULL")
    ended = open_
    while not ended.isEmpty():
        # only what still climbs is joined and written again
        far = done.unionByName(open_).select(F.col("node").alias("next"), F.col("next").alias("n2"), F.col("depth").alias("d2"), F.col("root").alias("r2"), F.col("lost").alias("l2"))
        moved = materialise(follow(open_, far, ["next"], many).select("node", F.col("n2").alias("next"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"), F.coalesce("root", "r2").alias("root"), (F.col("lost") | F.coalesce("l2", F.lit(False))).alias("lost")))
        ended, open_ = moved.where("next IS NULL"), moved.where("next IS NOT NULL")
        done = done.unionByName(ended)
    step = done.unionByName(open_)
    return step.select("node", F.when(~F.col("lost") & F.col("next").isNull(), F.col("root")).alias("root"), "depth")
