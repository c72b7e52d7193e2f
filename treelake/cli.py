"""Command line: build a dataset, audit names, train, evaluate and analyze a run, recommend a dimension, draw vectors."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.manifolds import LOSSES, MANIFOLDS
from .functions.names import curriculum_phases, dataset_name
from .operators import metrics, noise, pairs, projection, training, tree
from .plans.build import build_dataset
from .sources import readers, writers
from .tables import saved


def _nodes(spark: SparkSession, dump: str):
    nodes = readers.nodes_dump(spark, f"{dump}/nodes.dmp")
    names = readers.preferred_names(readers.names_dump(spark, f"{dump}/names.dmp"))
    return nodes.join(names, "taxid", "left")


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes = _nodes(spark, a.dump)
    hit = tree.resolve(nodes, a.identifier).first()
    if hit is None:
        raise SystemExit(f"no node is called {a.identifier}")
    name = spark.createDataFrame([(hit.name or str(hit.taxid), hit.taxid, a.max_depth, a.clean)], "n string, t long, d int, c boolean").select(dataset_name(F.col("n"), F.col("t"), F.col("d"), F.col("c"))).first()[0]
    if not a.force and writers.exists(spark, f"{a.out}/{name}/manifest"):
        print(f"{name} is there; --force builds it anew")
        return
    data = build_dataset(nodes, hit.taxid, name, a.out, a.max_depth, a.max_pairs, a.clean)
    print(f"{data.name}: {data.node_count} nodes, {data.edge_count} edges, {data.pairs_count} pairs, depth {data.max_depth}")


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    table = readers.pairs_parquet(spark, f"{a.dataset}/pairs")
    edges = readers.edge_list(spark, f"{a.dataset}/edges")
    mapping = readers.mapping_tsv(spark, f"{a.dataset}/mapping")
    root = tree.roots(edges).first().taxid
    nodes = training.node_table(tree.node_paths(edges, root), mapping)
    phases = curriculum_phases(a.curriculum_phases) if a.curriculum_phases else None
    n_pairs = table.count() if a.batch_size else 0
    options = training.Options(phases=phases, batches=max(1, -(-n_pairs // a.batch_size)) if a.batch_size else 4, burn_in_rate=a.burnin_multiplier, margin_low=a.margin_min, margin_high=a.margin_max, max_pairs=a.max_pairs, class_balanced=a.class_balanced, dim=a.dim or metrics.recommended_dimension(nodes.count()), epochs=a.epochs, negatives=a.n_negatives, rate=a.lr, margin=a.margin, radial=a.lambda_reg, schedule=a.radial_schedule, curriculum=a.curriculum or bool(phases), burn_in=a.burnin, nudge=a.radial_nudge, patience=a.early_stopping, fraction=a.epoch_fraction, tiered=a.tiered_negatives, scaled_margin=a.depth_scale_margin, class_weights=a.class_weighted_loss, riemannian=a.optimizer == "riemannian", optimizer="rsgd" if a.optimizer == "rsgd" else "adam", manifold=a.manifold, loss=a.loss, accumulate=a.accumulate)
    started, ended = time.time(), "failed"
    try:
        vectors, history = training.train(table, nodes, options, f"{a.out}/checkpoints", a.resume)
        vectors.write.mode("overwrite").parquet(f"{a.out}/vectors")
        history.orderBy("epoch").show(a.epochs, False)
        ended = "done"
    finally:  # a run that broke off can still be looked at by its checkpoints
        chosen = {k: v for k, v in vars(a).items() if k != "do"}
        writers.record(spark, {"dataset": a.dataset, "created_at": started, "seconds": time.time() - started, "status": ended, "args": chosen, "checkpoints": f"{a.out}/checkpoints", "best": f"{a.out}/checkpoints/best"}, f"{a.out}/run.json")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    vectors = readers.vectors_parquet(spark, f"{a.run}/vectors")
    table = readers.pairs_parquet(spark, f"{a.dataset}/pairs")
    depth = pairs.depth_of_indices(table)
    rows = metrics.norms(vectors).join(depth, "idx")
    metrics.depth_norm_correlation(rows).show()
    metrics.hierarchy_share(table, vectors).show()
    classes = table.where("ancestor_depth = 1").select(F.col("descendant_idx").alias("idx"), F.col("ancestor_idx").alias("class"))
    labeled = vectors.join(classes, "idx")
    metrics.knn_purity(labeled, "class", a.k).show()
    metrics.class_separation(labeled, "class").show()


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    """The audit of the names below a node as a CSV, and the ids that pruning keeps."""
    nodes = _nodes(spark, a.dump)
    paths = tree.node_paths(tree.edges_of(nodes), a.root)
    writers.audit(noise.audit(paths, nodes), f"{a.out}/audit")
    writers.ids(noise.prune(paths, nodes, a.root), f"{a.out}/kept")


def analyze(spark: SparkSession, a: argparse.Namespace) -> None:
    """Depth against norm with significance and verdict, and how far the groups of each depth lie apart, as one JSON record."""
    vectors = saved(readers.vectors_parquet(spark, f"{a.run}/vectors"), "vectors")
    table = readers.pairs_parquet(spark, f"{a.dataset}/pairs")
    rows = metrics.norms(vectors).join(pairs.depth_of_indices(table), "idx")
    report = {"depth_and_norm": metrics.correlation_report(rows, "depth", "norm").first().asDict(), "boundary": metrics.boundary_report(vectors).first().asDict(), "hierarchy": metrics.hierarchy_share(table, vectors).first().asDict(), "groups": {}}
    for depth in a.depths:
        labels = table.where(F.col("ancestor_depth") == depth).select(F.col("descendant_idx").alias("idx"), F.col("ancestor_idx").alias("class"))
        found = metrics.group_distances(metrics.group_pairs(vectors.join(labels, "idx"), "class", least=a.min_size, metric=a.metric))
        report["groups"][str(depth)] = found.withColumn("verdict", metrics.separation_verdict(F.col("ratio"))).first().asDict()
    writers.record(spark, report, a.out)
    print(json.dumps(report, indent=1))


def dim(spark: SparkSession, a: argparse.Namespace) -> None:
    n = readers.mapping_tsv(spark, f"{a.dataset}/mapping").count()
    print(f"{n} nodes: packing {metrics.packing_dimension(n, a.max_cosine)}, recommended {metrics.recommended_dimension(n, max_cosine=a.max_cosine)}")
    if a.run:
        used = metrics.participation_ratio(readers.vectors_parquet(spark, f"{a.run}/vectors")).first().participation_ratio
        print(f"the run's vectors use {used:.2f} dimensions")


def visualize(spark: SparkSession, a: argparse.Namespace) -> None:
    """Two coordinates and a label of each point, as a TSV: the main components at the Fréchet mean, a stand-in for neighbour embeddings."""
    vectors = saved(readers.vectors_parquet(spark, f"{a.run}/vectors"), "vectors")
    labels = vectors.select("idx", F.lit("Other").alias("label"))
    if a.group:
        edges, mapping = readers.edge_list(spark, f"{a.dataset}/edges"), readers.mapping_tsv(spark, f"{a.dataset}/mapping")
        paths = tree.node_paths(edges, tree.roots(edges).first().taxid)
        groups = spark.createDataFrame([(str(g), g, i) for i, g in enumerate(a.group)], "label string, root long, priority int")
        labels = tree.first_group(paths, groups).join(mapping, "taxid").select("idx", "label")
    trained = readers.pairs_parquet(spark, f"{a.dataset}/pairs") if a.trained_only else None
    trained = trained and pairs.used_indices(trained)
    writers.tsv(projection.picture(vectors, labels, a.sample, a.only, trained, a.metric), a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="treelake", description=__doc__)
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("build")
    p.add_argument("identifier")
    p.add_argument("--dump", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--max-depth", type=int)
    p.add_argument("--max-pairs", type=int)
    p.add_argument("--clean", action="store_true")
    p.add_argument("--force", action="store_true", help="build what is there already")
    p.set_defaults(do=build)
    p = sub.add_parser("audit")
    p.add_argument("root", type=int)
    p.add_argument("--dump", required=True)
    p.add_argument("--out", required=True)
    p.set_defaults(do=audit)
    p = sub.add_parser("train")
    p.add_argument("dataset")
    p.add_argument("--out", required=True)
    for name, kind, default in (("dim", int, 0), ("epochs", int, 10), ("n-negatives", int, 10), ("lr", float, 0.01), ("margin", float, 0.1), ("lambda-reg", float, 0.01), ("burnin", int, 0), ("radial-nudge", float, 0.0), ("early-stopping", int, 10), ("epoch-fraction", float, 1.0), ("burnin-multiplier", float, 0.1), ("margin-min", float, 0.05), ("margin-max", float, 1.0), ("max-pairs", int, 0), ("batch-size", int, 0)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--curriculum-phases", help="first epoch:deepest difference, ..., such as 1:1,20:3,50:None")
    p.add_argument("--radial-schedule", choices=("linear", "log"), default="linear")
    p.add_argument("--optimizer", choices=("adam", "riemannian", "rsgd"), default="adam")
    p.add_argument("--manifold", choices=tuple(MANIFOLDS), default="poincare")
    p.add_argument("--loss", choices=tuple(LOSSES), default="ranking")
    p.add_argument("--accumulate", type=int, default=1)
    for name in ("curriculum", "tiered-negatives", "depth-scale-margin", "class-weighted-loss", "class-balanced", "resume"):
        p.add_argument(f"--{name}", action="store_true")
    p.set_defaults(do=train)
    p = sub.add_parser("evaluate")
    p.add_argument("run")
    p.add_argument("--dataset", required=True)
    p.add_argument("--k", type=int, default=10)
    p.set_defaults(do=evaluate)
    p = sub.add_parser("dim")
    p.add_argument("dataset")
    p.add_argument("--max-cosine", type=float, default=0.3)
    p.add_argument("--run")
    p.set_defaults(do=dim)
    p = sub.add_parser("analyze")
    p.add_argument("run")
    p.add_argument("--dataset", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--depths", type=int, nargs="+", default=[1])
    p.add_argument("--min-size", type=int, default=10)
    p.add_argument("--metric", choices=("poincare", "euclidean"), default="poincare")
    p.set_defaults(do=analyze)
    for name in ("visualize", "project"):
        p = sub.add_parser(name)
        p.add_argument("run")
        p.add_argument("--out", required=True)
        p.add_argument("--dataset")
        p.add_argument("--group", type=int, action="append", help="a node whose descendants get a colour; the first that holds a point counts")
        p.add_argument("--sample", type=int, default=0)
        p.add_argument("--metric", choices=("poincare", "euclidean"), default="poincare")
        p.add_argument("--only", action="store_true", help="leave out points of no group")
        p.add_argument("--trained-only", action="store_true")
        p.set_defaults(do=visualize)
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.do(SparkSession.builder.appName("treelake").getOrCreate(), a)


if __name__ == "__main__":
    main()
