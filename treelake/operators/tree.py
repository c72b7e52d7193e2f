"""Trees: every node gets its path from the root once; the rest are array expressions on it.

nodes(taxid, parent, rank, name); edges(parent, child); paths(taxid, path, depth), path[0] the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import MANY, met, saved


def edges_of(nodes: DataFrame) -> DataFrame:
    """Parent-child pairs; self-loops, which some sources use for the root, are dropped."""
    return nodes.where("taxid is not null and parent is not null and parent <> taxid").select("parent", F.col("taxid").alias("child"))


def node_paths(edges: DataFrame, root: int, max_depth: int | None = None, most: int = MANY) -> DataFrame:
    """The subtree of `root`: (taxid, path, depth), root included, at most `max_depth` levels below it.

    By path doubling: each round appends to every unfinished chain of ancestors the chain of its last
    one, so a tree of d levels takes log2(d) joins of one row a node, however deep it is. Nodes that don't
    lead to the root are left out, those as soon as their chain meets itself that lead into a cycle; of several parents of a node the least counts. Each
    round is written, so the plan stays short. A node that is the last of more than `most` chains meets them by broadcast.
    """
    spark = edges.sparkSession
    up = edges.where(F.col("child") != root).groupBy(F.col("child").alias("taxid")).agg(F.min("parent").alias("top"))
    open_, done = saved(up.select("taxid", F.array("taxid").alias("chain"), "top"), "chains"), None
    while True:
        ended = open_.where(F.col("top") == root).select("taxid", "chain")
        done = ended if done is None else done.unionByName(ended)
        rest = open_.where(F.col("top") != root)
        if rest.isEmpty():
            break
        # the chain above a node may be open or ended; where it is neither, the node is unreachable
        above = rest.select(F.col("taxid").alias("top"), F.col("chain").alias("more"), F.col("top").alias("next"))
        above = above.unionByName(done.select(F.col("taxid").alias("top"), F.col("chain").alias("more"), F.lit(root).cast("long").alias("next")))
        grown = met(rest, above, "top", most).select("taxid", F.concat("chain", "more").alias("chain"), F.col("next").alias("top"))
        if max_depth is not None:
            grown = grown.where(F.size("chain") <= max_depth)
        open_ = saved(grown.where((F.col("top") == root) | ~F.array_contains("chain", F.col("top"))), "chains")
    start = spark.createDataFrame([(root,)], "taxid long").select("taxid", F.array().cast("array<bigint>").alias("chain"))
    nodes = start if max_depth is not None and max_depth <= 0 else start.unionByName(done)
    if max_depth is not None:
        nodes = nodes.where(F.size("chain") <= max_depth)
    return nodes.select("taxid", F.concat(F.array(F.lit(root).cast("long")), F.reverse("chain")).alias("path"), F.size("chain").alias("depth"))


def closure(paths: DataFrame) -> DataFrame:
    """All (ancestor, descendant) pairs with depths; a node isn't its own ancestor."""
    each = paths.select(F.posexplode("path").alias("ancestor_depth", "ancestor"), F.col("taxid").alias("descendant"), F.col("depth").alias("descendant_depth"))
    return each.where("ancestor_depth < descendant_depth").select("ancestor", "descendant", (F.col("descendant_depth") - F.col("ancestor_depth")).alias("depth_diff"), "ancestor_depth", "descendant_depth")


def ancestors(paths: DataFrame) -> DataFrame:
    """(taxid, ancestors): nearest first, the root last."""
    return paths.select("taxid", F.reverse(F.slice("path", 1, F.col("depth"))).alias("ancestors"))


def ancestor_at(depth: int) -> Column:
    """The self-or-ancestor at a depth, null above it."""
    return F.get("path", F.lit(depth))


def grandparents(paths: DataFrame) -> DataFrame:
    return paths.where("depth >= 2").select("taxid", F.get("path", F.col("depth") - 2).alias("grandparent"))


def class_labels(paths: DataFrame) -> DataFrame:
    """(taxid, class): the ancestor one below the root; the root has none."""
    return paths.where("depth >= 1").select("taxid", ancestor_at(1).alias("class"))


def subtree(paths: DataFrame, root: int) -> DataFrame:
    """Self and descendants of a node, with depths relative to it."""
    at = F.array_position("path", F.lit(root).cast("long")).cast("int")
    return paths.where(at > 0).select("taxid", (F.col("depth") - at + 1).alias("depth"))


def subtree_sizes(paths: DataFrame) -> DataFrame:
    """(taxid, subtree_size), self included: counts by ancestor are summed in the tasks first."""
    return paths.select(F.explode("path").alias("taxid")).groupBy("taxid").agg(F.count("*").alias("subtree_size"))


def ancestor_at_rank(paths: DataFrame, nodes: DataFrame, rank: str) -> DataFrame:
    """(taxid, ancestor): nearest self-or-ancestor of that rank, null without one."""
    of_rank = nodes.where(F.col("rank") == rank).select(F.col("taxid").alias("ancestor"))
    hit = paths.select("taxid", F.posexplode("path").alias("pos", "ancestor")).join(of_rank, "ancestor").groupBy("taxid").agg(F.max_by("ancestor", "pos").alias("ancestor"))
    return paths.select("taxid").join(hit, "taxid", "left")


def group_members(paths: DataFrame, groups: DataFrame) -> DataFrame:
    """(label, taxid) for groups(label, root): each group's root and its descendants."""
    return paths.select("taxid", F.explode("path").alias("root")).join(groups, "root").select("label", "taxid")


def first_group(paths: DataFrame, groups: DataFrame, default: str = "Other") -> DataFrame:
    """(taxid, label): of the groups(label, root, priority) that hold a node, that of the least priority."""
    held = paths.select("taxid", F.explode("path").alias("root")).join(groups, "root").groupBy("taxid").agg(F.min_by("label", "priority").alias("label"))
    return paths.select("taxid").join(held, "taxid", "left").select("taxid", F.coalesce("label", F.lit(default)).alias("label"))


def roots(edges: DataFrame) -> DataFrame:
    """Parents that are nobody's child."""
    return edges.select(F.col("parent").alias("taxid")).distinct().join(edges.select(F.col("child").alias("taxid")), "taxid", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("taxid")).join(edges.select(F.col("parent").alias("taxid")), "taxid", "left_anti")


def children_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent").agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"), F.max("child").alias("last_child"))


def adjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(parent, neighbors): children as a sorted list. A list holds all children of one node, so it is for
    nodes whose fan-out fits a row; `children_counts` and joins on edges do for the rest."""
    item = F.struct("child", weight) if weight else F.col("child")
    return edges.groupBy("parent").agg(F.sort_array(F.collect_list(item)).alias("neighbors"))


def resolve(nodes: DataFrame, identifier: str) -> DataFrame:
    """(taxid, name) that an identifier names: digits are an id, anything else a name (the least id wins)."""
    hit = nodes.where(F.col("taxid") == int(identifier)) if identifier.isdigit() else nodes.where(F.col("name") == identifier)
    return hit.groupBy().agg(F.min_by(F.struct("taxid", "name"), "taxid").alias("m")).where("m is not null").select("m.taxid", "m.name")


def named(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Adds the name of each node, or its id as TaxID_n."""
    return nodes.join(names.select("taxid", "name"), "taxid", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("TaxID_"), F.col("taxid").cast("string"))))
