"""Training vectors on a manifold: a driver loop of DataFrame jobs, two jobs a step."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.names import automatic_phases
from ..functions.manifolds import MANIFOLDS, Poincare, ranking
from ..sources import readers, writers
from ..tables import new_folder, saved
from . import blocks, metrics, pairs, sampling

#: What is measured of each epoch.
MEASURES = ("loss", "depth_norm_corr", "hierarchy_pct", "knn_purity", "class_sep_ratio", "quality")


@dataclass
class Options:
    dim: int = 10
    epochs: int = 10
    negatives: int = 10
    rate: float = 0.01
    margin: float = 0.1
    scaled_margin: bool = False
    radial: float = 0.01
    schedule: str = "linear"
    batches: int = 4
    curriculum: bool = True
    burn_in: int = 0
    burn_in_rate: float = 0.1
    phases: list | None = None  # (first epoch, deepest difference) in place of the automatic ones
    margin_low: float = 0.05
    margin_high: float = 1.0
    max_pairs: int = 0
    class_balanced: bool = False
    measured: int = 1000  # nodes that neighbour purity and class separation of an epoch are taken of
    nudge: float = 0.0
    patience: int = 10
    fraction: float = 1.0
    tiered: bool = False
    riemannian: bool = False
    optimizer: str = "adam"  # or "rsgd": sparse steps along the manifold, without moments
    manifold: str = "poincare"
    loss: str = "ranking"
    accumulate: int = 1  # batches whose gradients are added up for a step
    class_weights: bool = False
    seed: int = 7
    tiers: list = field(default_factory=lambda: [("depth", ["depth"], 1 << 30)])


def initial_vectors(nodes: DataFrame, dim: int, max_depth: int, schedule: str = "linear", seed: int = 7) -> DataFrame:
    """(idx, depth, vec): a direction drawn by hashing (idx, dimension), at the radius of the node's depth."""
    uniform = lambda k, d: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("idx"), d), F.lit(1 << 53)) + 1) / float((1 << 53) + 1)
    gauss = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda d: F.sqrt(-2 * F.ln(uniform(0, d))) * F.cos(2 * math.pi * uniform(1, d)))
    raw = nodes.select("idx", "depth", gauss.alias("g"))
    radius = V.target_radius(F.col("depth").cast("double"), F.lit(float(max_depth)), schedule)
    return raw.select("idx", "depth", V.scale(F.col("g"), radius / F.greatest(V.norm(F.col("g")), F.lit(1e-12))).alias("vec"))


def uniform_vectors(nodes: DataFrame, dim: int, most: float = 1e-3, seed: int = 7) -> DataFrame:
    """(idx, vec): each coordinate drawn evenly from -most to most, by a hash of (seed, idx, coordinate)."""
    from .sampling import draw

    part = lambda k: (2 * draw(seed, F.lit(1 << 40), F.col("idx"), k) / float(1 << 40) - 1) * most
    return nodes.select("idx", F.array(*[part(F.lit(k)) for k in range(dim)]).alias("vec"))


def loss_and_gradient(anc, desc, neg, margin, weight):
    """`ranking` in the Poincaré ball."""
    return ranking(Poincare(), anc, desc, neg, margin, weight)


def _moved(packed: DataFrame, change) -> DataFrame:
    """Packed blocks whose x is change(x, target); moments that are missing start at 0."""
    kinds = "block int, idx binary, target binary, pools binary, x binary, m binary, v binary"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                n = len(r["idx"]) // 8
                x = np.ascontiguousarray(change(np.frombuffer(r["x"], "<f8").reshape(n, -1), np.frombuffer(r["target"], "<f8")))
                zero = np.zeros_like(x).tobytes()
                yield pa.RecordBatch.from_pylist([{"m": zero, "v": zero, **r, "x": x.tobytes()}], schema=blocks.schema_of(kinds))

    return packed.mapInArrow(run, kinds)


def start_blocks(rows: DataFrame, size: int, manifold: str = "poincare") -> DataFrame:
    """Packed blocks of rows(idx, target, pools, vec), where vec is a point of the ball."""
    space = MANIFOLDS[manifold]()
    packed = blocks.pack(rows.select("idx", F.col("target"), F.col("pools"), F.col("vec").alias("x")), size, {"target": "<f8", "pools": "<i8", "x": "<f8"})
    return _moved(packed, lambda x, _: space.of_ball(x))


def ball_vectors(packed: DataFrame, manifold: str = "poincare") -> DataFrame:
    """(idx, vec): the image in the ball of each packed vector."""
    space = MANIFOLDS[manifold]()
    return blocks.unpack(_moved(packed, lambda x, _: space.to_ball(x)), {"x": "<f8"}).withColumnRenamed("x", "vec")


def nudged(packed: DataFrame, share: float, manifold: str = "poincare") -> DataFrame:
    """Packed blocks whose images in the ball went a share of the way to their target radius."""
    space = MANIFOLDS[manifold]()

    def change(x, target):
        import numpy as np

        u = space.to_ball(x)
        n = np.maximum(np.sqrt((u * u).sum(1)), 1e-8)
        r = np.clip(n * (1 - share) + target * share, 1e-6, 1 - 1e-6)
        return space.of_ball(u * (r / n)[:, None])

    return _moved(packed, change)


def phase_limit(phases: list, epoch: int) -> int | None:
    """The deepest difference of the last phase that has begun; None (all) before the first."""
    return next((d for e, d in sorted(phases, key=lambda x: x[0], reverse=True) if e <= epoch), None)


def epoch_metrics(table: DataFrame, nodes: DataFrame, state: DataFrame, loss: float, measured: int, seed: int) -> dict:
    """What a checkpoint records. Purity and separation by class are of a sample of `measured` nodes, 0 without classes."""
    out = {"loss": float(loss)}
    out["depth_norm_corr"] = float(metrics.depth_norm_correlation(metrics.norms(state).select("depth", "norm")).first().pearson or 0)
    out["hierarchy_pct"] = float(metrics.hierarchy_share(table, state.select("idx", "vec")).first().hierarchy_pct or 0)
    purity, ratio = 0.0, 0.0
    if "class" in nodes.columns:
        some = sampling.simple_sample(nodes.where("class is not null").select("idx", "class"), measured, seed, ["idx"])
        rows = saved(state.select("idx", "vec").join(some, "idx"), "measured")
        purity = metrics.knn_purity(rows, "class").first().purity
        ratio = metrics.class_separation(rows, "class").first().ratio
    out |= {"knn_purity": float(purity), "class_sep_ratio": float(ratio)}
    return out | {"quality": out["depth_norm_corr"] + out["hierarchy_pct"] / 100 + purity + ratio - 1}


def epoch_links(table: DataFrame, nodes: DataFrame, o: Options, epoch: int, limit: int | None, deepest: int, weights: DataFrame | None) -> DataFrame:
    """(ancestor_idx, descendant_idx, margin, raw, batch): the links of an epoch, written by batch so that a step reads its own only."""
    keys = ["ancestor_idx", "descendant_idx"]
    now = table.where("ancestor_idx <> descendant_idx")
    if limit is not None:
        now = now.where(F.col("depth_diff") <= limit)
    if o.fraction < 1:
        now = sampling.fraction_sample(now, "depth_diff", o.fraction, o.seed + epoch, keys)
    if o.class_balanced:
        owned = now.join(nodes.select(F.col("idx").alias("descendant_idx"), F.col("class").alias("_class")), "descendant_idx").where("_class is not null")
        now = sampling.class_balanced(owned, "_class", owned.count(), o.seed + epoch, keys).drop("_class")
    if weights is not None:
        now = now.join(nodes.select(F.col("idx").alias("descendant_idx"), "class"), "descendant_idx").join(weights, "class", "left")
    margin = V.depth_margin(F.col("depth_diff"), F.lit(float(max(deepest, 1))), o.margin_low, o.margin_high) if o.scaled_margin else F.lit(o.margin)
    weight = F.sqrt(F.col("depth_diff") + 1.0) * (F.coalesce("class_weight", F.lit(1.0)) if weights is not None else F.lit(1.0))
    batch = F.pmod(F.xxhash64(*keys, *(["draw_no"] if o.class_balanced else []), F.lit(epoch)), F.lit(o.batches * max(1, o.accumulate)))
    rows = now.select(*keys, margin.alias("margin"), weight.alias("raw"), batch.cast("int").alias("batch"))
    folder = new_folder(table.sparkSession, "epoch")
    rows.repartition("batch", F.pmod(F.xxhash64(*keys), F.lit(16))).write.partitionBy("batch").parquet(f"{folder}/links")
    return table.sparkSession.read.schema(rows.schema).parquet(f"{folder}/links")


def train(table: DataFrame, nodes: DataFrame, options: Options | None = None, folder: str | None = None, resume: bool = False) -> tuple[DataFrame, DataFrame]:
    """(best vectors, history) from pairs and nodes(idx, depth, <tier columns>).

    Vectors lie in packed blocks (see `blocks`). Each epoch: the pairs of the curriculum's phase, `batches` steps, each over
    `accumulate` batches whose mean loss it lowers; negatives are drawn in the tasks, afresh each epoch, from the blocks
    at hand. The state is written after every step, so the plan never grows and a lost executor repeats one step.
    `manifold`, `loss` and `optimizer` are named as in MANIFOLDS, LOSSES and Options; vectors come back as points of
    the ball (of flat space for "euclidean"). The best epoch is that of the least loss or, under a curriculum, whose
    phases make losses incomparable, of the highest quality; epochs of burn-in are never best. Early stop after
    `patience` epochs that are not (0: never). `folder` gets the last checkpoints, `best` and `final`; with
    `resume`, training goes on after the last one there. Without a best epoch the last vectors are returned.
    """
    o = options or Options()
    if o.dim < 1:
        raise ValueError("vectors need a dimension")
    spark = table.sparkSession
    facts = nodes.agg(F.max("depth").alias("deepest"), F.count("*").alias("n"), F.max("idx").alias("last")).first()
    deepest, n = facts.deepest or 0, facts.n
    radius: Column = V.target_radius(F.col("depth").cast("double"), F.lit(float(deepest)), o.schedule)
    tiers = o.tiers if not o.tiered else [("grandparent", ["gp", "depth"], o.negatives // 2), ("class", ["class", "depth"], o.negatives // 2 + int(0.3 * o.negatives)), ("depth", ["depth"], 1 << 30)]
    ends = [high for *_, high in tiers]
    space = MANIFOLDS[o.manifold]()
    size = blocks.rows_of_block(space.width(o.dim))
    n_blocks = 1 + (facts["last"] or 0) // size
    held = nodes.select("idx", blocks.pool_keys(tiers).alias("pools"))
    start = initial_vectors(nodes, o.dim, deepest, o.schedule, o.seed).withColumn("target", radius).join(held, "idx")
    state = saved(start_blocks(start, size, o.manifold), "state")
    phases = (o.phases or automatic_phases(deepest, o.epochs)) if o.curriculum else [(1, None)]
    if o.max_pairs:
        table = saved(sampling.stratified_subsample(table, "depth_diff", o.max_pairs, o.seed, ["ancestor_idx", "descendant_idx"]), "pairs")
    history, best, best_vectors, waited, step, done = [], -math.inf, None, 0, 0, 0
    last = writers.last_checkpoint(spark, folder) if resume and folder else None
    if last:
        path, done, notes = last
        old = spark.read.schema("idx int, vec array<double>, m array<double>, v array<double>").parquet(f"{path}/vectors")
        rows = old.join(nodes.select("idx", radius.alias("target")), "idx").join(held, "idx").withColumnRenamed("vec", "x")
        state = saved(_moved(blocks.pack(rows, size, {"target": "<f8", "pools": "<i8", "x": "<f8", "m": "<f8", "v": "<f8"}), lambda x, _: x), "state")
        step, waited, best = notes["step"], notes["waited"], -math.inf if notes["best"] is None else notes["best"]
        if notes["best"] is not None:
            best_vectors = saved(readers.vectors_parquet(spark, f"{folder}/best/vectors"), "best")
    versions = blocks.Versions(state) if o.optimizer == "rsgd" else None
    weights = metrics.class_weights(nodes.select("class")).select("class", F.col("weight").alias("class_weight")) if o.class_weights else None
    for epoch in range(done + 1, o.epochs + 1):
        full = epoch_links(table, nodes, o, epoch, phase_limit(phases, epoch), deepest, weights)
        sizes = {r.batch: (r.n, r.mean) for r in full.groupBy("batch").agg(F.count("*").alias("n"), F.avg("raw").alias("mean")).collect()}
        total, parts = 0.0, max(1, o.accumulate)
        rate = o.rate * (o.burn_in_rate if epoch <= o.burn_in else 1.0)
        for first in range(0, o.batches * parts, parts):
            mine = [b for b in range(first, first + parts) if b in sizes]
            if not mine:
                continue
            step += 1
            even = F.coalesce(*[F.when(F.col("batch") == b, 1.0 / (sizes[b][0] * sizes[b][1] * len(mine))) for b in mine])
            links = full.where(F.col("batch").isin(mine)).withColumn("weight", F.col("raw") * even)
            now = state if versions is None else versions.current()
            grads = blocks.block_gradients(links, now, o.manifold, o.loss, o.negatives, ends, size, n_blocks, o.seed + 1000 * epoch + first)
            if versions is None:
                state, loss, _ = blocks.adam_blocks(state, grads, step, rate, o.radial, n, o.manifold, riemannian=o.riemannian)
            else:
                loss, _ = blocks.descend(versions, grads, rate, o.manifold, clear=o.loss == "cones")
            total += loss
        if versions is not None:
            state = versions.current()
        if o.nudge:
            state = saved(nudged(state, o.nudge, o.manifold), "state")
            versions = versions and blocks.Versions(state)
        rows = saved(ball_vectors(state, o.manifold).join(nodes.select("idx", "depth"), "idx"), "vectors")
        notes = epoch_metrics(table, nodes, rows, total / max(len(sizes) / parts, 1), o.measured, o.seed)
        score = notes["quality"] if o.curriculum else -notes["loss"]
        counts = epoch > o.burn_in
        better = counts and score > best
        if better:
            best, waited, best_vectors = score, 0, rows.select("idx", "vec")
        elif counts:
            waited += 1
        history.append((epoch, *[notes[c] for c in MEASURES], better))
        if folder:
            if better:
                writers.kept_checkpoint(best_vectors, {"epoch": epoch, **notes}, f"{folder}/best")
            whole = blocks.unpack(state, {c: "<f8" for c in blocks.STATE}).withColumnRenamed("x", "vec")
            writers.checkpoint(whole, {**notes, "step": step, "waited": waited, "best": best if best > -math.inf else None}, folder, epoch)
        if counts and 0 < o.patience <= waited:
            break
    if folder and history:
        writers.kept_checkpoint(rows.select("idx", "vec"), {"epoch": history[-1][0], **notes}, f"{folder}/final")
    schema = "epoch int, " + ", ".join(f"{c} double" for c in MEASURES) + ", best boolean"
    return ball_vectors(state, o.manifold) if best_vectors is None else best_vectors, spark.createDataFrame(history, schema)


def node_table(paths: DataFrame, mapping: DataFrame) -> DataFrame:
    """(idx, depth, gp, class): what samplers and training need of each node."""
    return paths.join(mapping, "taxid").select("idx", "depth", F.get("path", F.col("depth") - 2).alias("gp"), F.get("path", F.lit(1)).alias("class"))


__all__ = ["Options", "ball_vectors", "epoch_links", "initial_vectors", "loss_and_gradient", "node_table", "nudged", "pairs", "start_blocks", "train"]
