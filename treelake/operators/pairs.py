"""Dense indices, the table of training pairs, coverage and its repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import MANY, dense_index, saved
from .tree import closure

#: The columns of the table of pairs.
PAIRS = "ancestor_idx int, descendant_idx int, depth_diff int, ancestor_depth int, descendant_depth int, ancestor_taxid long, descendant_taxid long"
COLUMNS = [x.split()[0] for x in PAIRS.split(", ")]


def dense_mapping(ids: DataFrame) -> DataFrame:
    """(taxid, idx): 0.. in the order of the ids."""
    return dense_index(ids.select("taxid").distinct(), ["taxid"], "idx").select("taxid", "idx")


def first_seen_mapping(edges: DataFrame, position: str = "pos") -> DataFrame:
    """(taxid, idx): 0.. in the order in which ids first occur; in an edge the parent comes first."""
    ends = edges.select(F.posexplode(F.array("parent", "child")).alias("side", "taxid"), position)
    first = ends.groupBy("taxid").agg(F.min(2 * F.col(position) + F.col("side")).alias("at"))
    return dense_index(first, ["at"], "idx").select("taxid", "idx")


def pair_table(paths: DataFrame, mapping: DataFrame, most: int = MANY) -> DataFrame:
    """Closure pairs with indices; pairs with an unmapped end are dropped (see skipped_pairs).

    The root is in a pair with every node, so ancestors of more than `most` nodes take their index by broadcast (there are no
    more than pairs / most of them); the pairs of the others meet theirs by a join.
    """
    a = mapping.select(F.col("taxid").alias("ancestor"), F.col("idx").alias("ancestor_idx"))
    d = mapping.select(F.col("taxid").alias("descendant"), F.col("idx").alias("descendant_idx"))
    # the descendants' indices join one row a node, before the paths are exploded
    withd = paths.join(d, paths.taxid == d.descendant).select("taxid", "path", "depth", "descendant_idx")
    each = withd.select(F.posexplode("path").alias("ancestor_depth", "ancestor"), F.col("taxid").alias("descendant_taxid"), F.col("depth").alias("descendant_depth"), "descendant_idx").where("ancestor_depth < descendant_depth")
    each = each.withColumn("depth_diff", F.col("descendant_depth") - F.col("ancestor_depth"))
    hot = paths.select(F.explode(F.slice("path", 1, F.col("depth"))).alias("ancestor")).groupBy("ancestor").agg(F.count("*").alias("n")).where(F.col("n") > most)
    hot = saved(hot.join(a, "ancestor", "left").select("ancestor", "ancestor_idx"), "hot_ancestors")
    near = each.join(F.broadcast(hot.select("ancestor")), "ancestor", "left_anti").join(a, "ancestor")
    far = each.join(F.broadcast(hot.where("ancestor_idx is not null")), "ancestor")
    return far.unionByName(near).withColumnRenamed("ancestor", "ancestor_taxid").select(*COLUMNS)


def skipped_pairs(paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: how many closure pairs have an end without an index."""
    ends = mapping.select("taxid")
    pairs = closure(paths)
    ok = pairs.join(ends.withColumnRenamed("taxid", "ancestor"), "ancestor", "left_semi").join(ends.withColumnRenamed("taxid", "descendant"), "descendant", "left_semi")
    total, good = pairs.agg(F.count("*").alias("total")), ok.agg(F.count("*").alias("kept"))
    return total.join(F.broadcast(good), F.lit(True)).select("total", "kept", (F.col("total") - F.col("kept")).alias("skipped"))


def used_indices(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("ancestor_idx", "descendant_idx")).alias("idx")).distinct()


def coverage(mapping: DataFrame, used: DataFrame) -> DataFrame:
    """One row: total_nodes, used_nodes, missing_nodes, coverage_ratio; used indices outside the mapping don't count."""
    flag = mapping.select("idx").distinct().join(used.select("idx").distinct().withColumn("used", F.lit(1)), "idx", "left")
    both = flag.agg(F.count("*").alias("total_nodes"), F.count("used").alias("used_nodes"))
    return both.select("*", (F.col("total_nodes") - F.col("used_nodes")).alias("missing_nodes"), F.try_divide("used_nodes", "total_nodes").alias("coverage_ratio"))


def missing(mapping: DataFrame, used: DataFrame) -> DataFrame:
    return mapping.join(used, "idx", "left_anti")


def repair_coverage(pairs: DataFrame, mapping: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds a pair for each mapped index that no pair holds: with its parent, or with itself at difference 0."""
    lost = missing(mapping, used_indices(pairs))
    parent = edges.select(F.col("child").alias("taxid"), F.col("parent").alias("up"))
    known = mapping.select(F.col("taxid").alias("up"), F.col("idx").alias("up_idx"))
    depth, up_depth = paths.select("taxid", "depth"), paths.select(F.col("taxid").alias("up"), F.col("depth").alias("up_depth"))
    row = lost.join(parent, "taxid", "left").join(known, "up", "left").join(depth, "taxid", "left").join(up_depth, "up", "left")
    has = F.col("up_idx").isNotNull()
    a_depth = F.when(has, F.coalesce("up_depth", F.lit(0))).otherwise(F.coalesce("depth", F.lit(0)))
    d_depth = F.coalesce(F.col("depth"), a_depth)
    added = row.select(
        F.when(has, F.col("up_idx")).otherwise(F.col("idx")).alias("ancestor_idx"), F.col("idx").alias("descendant_idx"), F.greatest(d_depth - a_depth, F.lit(0)).alias("depth_diff"),
        a_depth.alias("ancestor_depth"), d_depth.alias("descendant_depth"), F.when(has, F.col("up")).otherwise(F.col("taxid")).alias("ancestor_taxid"), F.col("taxid").alias("descendant_taxid"),
    )
    return pairs.unionByName(added)


def mapped_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """(parent_idx, child_idx) of the edges whose two ends are mapped."""
    p = mapping.select(F.col("taxid").alias("parent"), F.col("idx").alias("parent_idx"))
    c = mapping.select(F.col("taxid").alias("child"), F.col("idx").alias("child_idx"))
    return edges.join(p, "parent").join(c, "child").select("parent_idx", "child_idx")


def depth_of_indices(pairs: DataFrame) -> DataFrame:
    """(idx, depth) from both ends of the pairs; the descendant's end wins. Plain minima, so that tasks add up in a hash table without sorting."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("descendant_idx").alias("idx"), F.col("descendant_depth").alias("below"), F.lit(None).cast("int").alias("above")), F.struct(F.col("ancestor_idx").alias("idx"), F.lit(None).cast("int").alias("below"), F.col("ancestor_depth").alias("above")))).alias("e")).select("e.*")
    return ends.groupBy("idx").agg(F.coalesce(F.min("below"), F.min("above")).alias("depth"))


def depth_bins(pairs: DataFrame) -> DataFrame:
    """Counts and shares of depth differences 1, 2, 3-5, 6-10, over 10."""
    d = F.col("depth_diff")
    label = F.when(d <= 1, "1").when(d == 2, "2").when(d <= 5, "3-5").when(d <= 10, "6-10").otherwise(">10")
    counts = pairs.groupBy(label.alias("bin")).agg(F.count("*").alias("n"), F.min("depth_diff").alias("least"), F.max("depth_diff").alias("most"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("bin", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("pct"), "least", "most")


def symmetrized(cooc: DataFrame) -> DataFrame:
    """Weighted pairs with their reverses added."""
    return cooc.select("id1", "id2", "weight").unionByName(cooc.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "weight"))


def unigram_weights(cooc: DataFrame, power: float = 0.75) -> DataFrame:
    """(id, count, weight): summed weights of an id as second end, and their power, for sampling negatives."""
    return cooc.groupBy(F.col("id2").alias("id")).agg(F.sum("weight").alias("count")).withColumn("weight", F.pow("count", F.lit(power)))


def within_bounds(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """Pairs whose two indices are no larger than the largest of emb(idx)."""
    top = emb.agg(F.max("idx").alias("_top"))
    return pairs.join(F.broadcast(top), (F.col("ancestor_idx") <= F.col("_top")) & (F.col("descendant_idx") <= F.col("_top"))).drop("_top")


def at_positions(pairs: DataFrame, positions: DataFrame, order: list[str]) -> DataFrame:
    """The pairs at positions(pos) in the order of the columns `order`, with pos."""
    return dense_index(pairs, order, "pos", "long").join(positions, "pos")


def first_pairs(edges: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n edges, as a small data set; each task keeps n at most."""
    return edges.orderBy(*order).limit(n)


def with_objects(edges: DataFrame, objects: DataFrame) -> DataFrame:
    """Edges with the objects(taxid, name) of both ends."""
    a = objects.select(F.col("taxid").alias("parent"), F.col("name").alias("parent_name"))
    return edges.join(a, "parent").join(objects.select(F.col("taxid").alias("child"), F.col("name").alias("child_name")), "child")
