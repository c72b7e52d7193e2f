"""Streams of nodes that arrive in a tree: running counts by ancestor. The batch operators have the same counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_by_difference(arrivals: DataFrame, paths: DataFrame) -> DataFrame:
    """(depth_diff, n) over a stream of new leaves (taxid, parent): the closure pairs that they add.

    The known tree is static; its paths join each batch by the parent, and the sums are kept as state, one row
    a depth difference.
    """
    known = paths.select(F.col("taxid").alias("parent"), "depth")
    new = arrivals.join(known, "parent").select(F.explode(F.sequence(F.lit(1), F.col("depth") + 1)).alias("depth_diff"))
    return new.groupBy("depth_diff").agg(F.count("*").alias("n"))


def arrivals_by_window(arrivals: DataFrame, paths: DataFrame, depth: int, width: str, late: str) -> DataFrame:
    """(window, class, n): new leaves with event time ts by the ancestor at `depth`; rows later than `late` are dropped."""
    known = paths.select(F.col("taxid").alias("parent"), F.get("path", F.lit(depth)).alias("class"))
    return arrivals.withWatermark("ts", late).join(known, "parent").groupBy(F.window("ts", width), "class").agg(F.count("*").alias("n"))
