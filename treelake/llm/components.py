"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node reachable.

    Each round hooks the larger neighbours of every node to its smallest neighbour (large star), then
    all smaller neighbours likewise (small star); O(log^2 n) rounds suffice. The minima are written
    as tables before they are joined back, so that Spark can split the join of a node with very many
    edges. Nothing but two numbers a round reaches the driver. Null ends and loops are left out; an
    empty table gives an empty table.
    """
    now = scratch.save(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-0"
    )
    seen = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), f"cc-low-{k}")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct(), f"cc-large-{k}")
        low2 = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), f"cc-low2-{k}")
        hooked = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(hooked.unionByName(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"cc-{k}")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for name in (f"cc-{k - 1}", f"cc-low-{k}", f"cc-large-{k}", f"cc-low2-{k}"):
            scratch.drop(name)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"no stable components after {rounds} rounds")
    # Every remaining edge leads from a node to the root of its star.
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
