"""Building a dataset from a tree: subtree, pruning, index, closure, coverage, subsample, files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import CONTAINERS, NOISE
from ..operators import noise, pairs, sampling, tree
from ..sources import writers
from ..tables import saved


@dataclass
class Dataset:
    name: str
    root_taxid: int
    node_count: int
    edge_count: int
    max_depth: int
    pairs_count: int
    paths: DataFrame
    mapping: DataFrame
    pairs: DataFrame
    files: dict[str, str]


def _every_node_first(table: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` pairs: one for each index first, so that none is lost, then by depth difference."""
    keys = ["ancestor_idx", "descendant_idx"]
    one = table.groupBy("descendant_idx").agg(F.max("ancestor_depth").alias("ancestor_depth"))
    need = table.join(one, ["descendant_idx", "ancestor_depth"], "left_semi")
    rest = table.join(need.select(*keys), keys, "left_anti")
    left = most - need.count()
    if left < 0:
        raise ValueError(f"{most} pairs can't cover all nodes")
    return need.unionByName(sampling.stratified_subsample(rest, "depth_diff", left, seed, keys)) if left else need


def build_dataset(nodes: DataFrame, root: int, name: str, folder: str | None = None, max_depth: int | None = None, max_pairs: int | None = None, clean: bool = False, patterns=None, seed: int = 1) -> Dataset:
    """The dataset of the subtree of `root` in nodes(taxid, parent, rank, name).

    clean prunes by the standard noise patterns; `patterns` (category, regex) replace them and prune as
    well. A dataset whose pairs don't cover its nodes is an error. With `folder` all files are written.
    """
    edges = tree.edges_of(nodes)
    paths = tree.node_paths(edges, root, max_depth)
    if clean or patterns:
        paths = noise.prune(paths, nodes, root, patterns or NOISE, CONTAINERS)
    paths = saved(paths, "paths")
    mapping = saved(pairs.dense_mapping(paths), "mapping")
    inside = edges.join(paths.where("depth > 0").select(F.col("taxid").alias("child")), "child", "left_semi").select("parent", "child")
    table = pairs.repair_coverage(pairs.pair_table(paths, mapping), mapping, inside, paths)
    table = saved(table, "pairs")
    if max_pairs is not None and table.count() > max_pairs:
        table = saved(_every_node_first(table, max_pairs, seed), "subsample")
    report = pairs.coverage(mapping, pairs.used_indices(table)).first()
    if report.missing_nodes:
        raise ValueError(f"{report.missing_nodes} of {report.total_nodes} nodes are in no pair")
    deepest = paths.agg(F.max("depth")).first()[0]
    out = Dataset(name, root, report.total_nodes, inside.count(), deepest, table.count(), paths, mapping, table, {})
    if folder:
        out.files = write_dataset(out, inside, nodes, folder, max_depth, clean)
    return out


def write_dataset(data: Dataset, edges: DataFrame, nodes: DataFrame, folder: str, max_depth: int | None, clean: bool) -> dict[str, str]:
    files = {k: f"{folder}/{data.name}/{k}" for k in ("mapping", "edges", "mapped_edges", "pairs", "manifest")}
    writers.tsv(data.mapping, files["mapping"])
    writers.edge_list(edges, files["edges"])
    writers.edge_list(pairs.mapped_edges(edges, data.mapping), files["mapped_edges"])
    writers.pairs_parquet(data.pairs, files["pairs"])
    top = nodes.where(F.col("taxid") == data.root_taxid).select("name").first()
    writers.record(nodes.sparkSession, {
        "dataset_name": data.name, "root_taxid": data.root_taxid, "root_name": top.name if top else None, "nodes": data.node_count, "edges": data.edge_count,
        "max_depth_observed": data.max_depth, "max_depth_requested": max_depth, "transitive_pairs": data.pairs_count, "clean": clean,
    }, files["manifest"])
    return files
