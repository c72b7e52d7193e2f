"""Noise in names: audit, pruning and re-parenting, without a fix-point loop.

The rule "remove a removable node once no child of it is left, again and again" keeps a node if and
only if some node at or below it is not removable. So the kept nodes are those on the paths of
nodes that are not removable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import CONTAINERS, NOISE, container_category, noise_categories
from ..tables import MANY, met, saved


def flags(nodes: DataFrame, noise=NOISE, containers=CONTAINERS) -> DataFrame:
    """Adds noise_categories (array) and container_category to nodes(taxid, name, ...)."""
    return nodes.select("*", noise_categories(F.col("name"), noise).alias("noise_categories"), container_category(F.col("name"), containers).alias("container_category"))


def kept_nodes(paths: DataFrame, removable: DataFrame, root: int | None) -> DataFrame:
    """(taxid) of the nodes that pruning keeps; `root` is exempt if given. removable(taxid) may be any set."""
    kept = paths.join(removable, "taxid", "left_anti").select(F.explode("path").alias("taxid"))
    if root is not None:
        kept = kept.unionByName(paths.where(F.col("taxid") == root).select("taxid"))
    return kept.distinct()


def removable_nodes(flagged: DataFrame, stale: Column) -> DataFrame:
    """Nodes that are noisy, containers or stale (no name, or no known rank)."""
    return flagged.where((F.size("noise_categories") > 0) | F.col("container_category").isNotNull() | stale).select("taxid")


def prune(paths: DataFrame, nodes: DataFrame, root: int, noise=NOISE, containers=CONTAINERS) -> DataFrame:
    """The paths that stay when noisy, unnamed and empty container nodes go; the root always stays."""
    drop = removable_nodes(flags(nodes, noise, containers), F.col("name").isNull())
    return paths.join(kept_nodes(paths, drop, root), "taxid", "left_semi")


def audit(paths: DataFrame, nodes: DataFrame, noise=NOISE, containers=CONTAINERS) -> DataFrame:
    """A row for every node: name, rank, subtree_size, noise_categories, is_flagged, is_removed, removal_reason.

    Here the root isn't exempt and a node is stale if its rank is unknown (null). Of several reasons
    noise comes first, then stale, then empty container.
    """
    from .tree import subtree_sizes

    flagged = paths.select("taxid").join(flags(nodes, noise, containers), "taxid", "left")
    flagged = flagged.withColumn("noise_categories", F.coalesce("noise_categories", F.array().cast("array<string>")))
    kept = kept_nodes(paths, removable_nodes(flagged, F.col("rank").isNull()), None).withColumn("kept", F.lit(True))
    label = F.array_join("noise_categories", "|")
    reason = F.when(F.size("noise_categories") > 0, label).when(F.col("rank").isNull(), "stale_taxid").otherwise(F.concat(F.lit("empty_container:"), F.col("container_category")))
    removed = F.col("kept").isNull()
    return (
        flagged.join(kept, "taxid", "left").join(subtree_sizes(paths), "taxid")
        .select("taxid", "name", F.coalesce("rank", F.lit("unknown")).alias("rank"), "subtree_size", label.alias("noise_categories"), (F.size("noise_categories") > 0).alias("is_flagged"), removed.alias("is_removed"), F.when(removed, reason).otherwise("").alias("removal_reason"))
    )


def noise_counts(audited: DataFrame) -> DataFrame:
    """Nodes by category; a node counts in each of its categories."""
    return audited.where("noise_categories <> ''").select(F.explode(F.split("noise_categories", r"\|")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def reason_counts(audited: DataFrame) -> DataFrame:
    return audited.where("is_removed").select(F.explode(F.split("removal_reason", r"\|")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def reason_examples(audited: DataFrame, k: int = 5) -> DataFrame:
    """(reason, rn, name): the first k names, by id, of each reason."""
    from pyspark.sql import Window

    each = audited.where("is_removed").select(F.explode(F.split("removal_reason", r"\|")).alias("reason"), "taxid", "name")
    return each.withColumn("rn", F.row_number().over(Window.partitionBy("reason").orderBy("taxid"))).where(F.col("rn") <= k).select("reason", "rn", "name")


def rank_distribution(audited: DataFrame, k: int = 15) -> DataFrame:
    """The k commonest ranks with how many of their nodes are removed."""
    by = audited.groupBy("rank").agg(F.count("*").alias("n"), F.count_if("is_removed").alias("removed"))
    return by.withColumn("removed_pct", F.round(100.0 * F.col("removed") / F.col("n"), 6)).orderBy(F.desc("n"), "rank").limit(k)


def depth_before_after(paths: DataFrame, kept: DataFrame) -> DataFrame:
    flag = paths.select("taxid", "depth").join(kept.select("taxid").withColumn("kept", F.lit(1)), "taxid", "left")
    return flag.groupBy("depth").agg(F.count("*").alias("before"), F.count("kept").alias("after"))


def reparent(paths: DataFrame, keep: DataFrame, most: int = MANY) -> DataFrame:
    """(taxid, parent, depth): the tree of an allow-list; the nearest kept ancestor becomes the parent.

    A kept node without a kept ancestor is a root (parent null, depth 0); there may be several. The root is above every node,
    so ancestors of more than `most` kept nodes meet them by broadcast.
    """
    kept = keep.select("taxid").distinct()
    # a semi-join would be pushed into the union of the paths' rounds, where a round of few rows gets all kept ids in one task
    base = saved(paths.join(kept, "taxid"), "kept_paths")
    each = base.select("taxid", F.posexplode(F.slice("path", 1, F.col("depth"))).alias("pos", "a"))
    on = met(each, kept.select(F.col("taxid").alias("a")), "a", most).select("taxid", "pos", "a")
    # a row without an ancestor for each kept node: it counts and ranks nothing, and keeps roots in the result
    own = base.select("taxid", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("long").alias("a"))
    return on.unionByName(own).groupBy("taxid").agg(F.max_by("a", "pos").alias("parent"), F.count("a").cast("int").alias("depth"))
