"""How well vectors reflect a hierarchy."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.special import correlation_p
from . import rings


def norms(emb: DataFrame) -> DataFrame:
    return emb.withColumn("norm", V.norm(F.col("vec")))


def norm_stats(emb: DataFrame) -> DataFrame:
    n = F.col("norm")
    return norms(emb).agg(F.count("*").alias("n"), F.min(n).alias("least"), F.avg(n).alias("mean"), F.max(n).alias("most"), F.count_if(n >= 1).alias("outside"), F.count_if(n > 0.9).alias("above_90"), F.count_if(n > 0.95).alias("above_95"))


def percentiles(rows: DataFrame, column: str, at) -> DataFrame:
    """(p, value) by linear interpolation: exact, by place in the sorted order, so that no task holds all values."""
    from ..tables import dense_index

    placed = dense_index(rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), ["v"], "i", "long")
    n = placed.agg(F.count("*").alias("n"))
    want = n.where("n > 0").select(F.explode(F.array(*[F.lit(float(x)) for x in at])).alias("p"), "n").withColumn("x", F.col("p") * (F.col("n") - 1))
    ends = want.select("p", "x", F.explode(F.array(F.floor("x"), F.ceil("x"))).alias("i"))
    hit = placed.join(F.broadcast(ends.distinct()), "i")  # two rows a percentile
    share = F.col("x") - F.floor("x")
    return hit.groupBy("p", "x").agg(F.min("v").alias("low"), F.max("v").alias("high")).select("p", (F.col("low") + share * (F.col("high") - F.col("low"))).alias("value"))


def norm_percentiles(emb: DataFrame, at=(0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)) -> DataFrame:
    return percentiles(norms(emb), "norm", at)


def dimension_variances(emb: DataFrame) -> DataFrame:
    """(dim, mean, variance): population variance of each coordinate."""
    return emb.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def trained_summary(emb: DataFrame, used: DataFrame) -> DataFrame:
    """(trained, n, mean_norm, max_norm): vectors whose idx occurs in used(idx), and the others."""
    flag = norms(emb).join(used.select("idx").distinct().withColumn("trained", F.lit(True)), "idx", "left")
    return flag.groupBy(F.coalesce("trained", F.lit(False)).alias("trained")).agg(F.count("*").alias("n"), F.avg("norm").alias("mean_norm"), F.max("norm").alias("max_norm"))


def compare_percentiles(before: DataFrame, after: DataFrame, at=(0.5, 0.9, 0.99)) -> DataFrame:
    """(p, before, after, delta): percentiles of the norms of two checkpoints."""
    one = lambda e, name: norm_percentiles(e, at).withColumnRenamed("value", name)
    return one(before, "before").join(one(after, "after"), "p").withColumn("delta", F.col("after") - F.col("before"))


def boundary_report(emb: DataFrame, close: float = 0.95) -> DataFrame:
    """One row: vectors, the percentage with a norm of `close` or more, the largest norm, and whether all lie in the ball."""
    n = F.col("norm")
    return norms(emb).agg(F.count("*").alias("n"), (100 * F.avg((n >= close).cast("double"))).alias("close_pct"), F.max(n).alias("most"), F.coalesce(F.max(n) < 1, F.lit(True)).alias("inside"))


def compare_vectors(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta): norms of two checkpoints side by side."""
    names = ("least", "mean", "most", "outside", "above_90", "above_95")
    one = lambda e, name: norm_stats(e).select(F.explode(F.create_map(*[y for x in names for y in (F.lit(x), F.col(x).cast("double"))])).alias("metric", name))
    return one(before, "before").join(one(after, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))


def backfilled_depths(mapping: DataFrame, pair_depths: DataFrame, tree_depths: DataFrame, deepest: int) -> DataFrame:
    """(idx, depth, origin): the depth from the pairs, else from the tree by taxid, else the deepest level."""
    a = mapping.join(pair_depths.select("idx", F.col("depth").alias("d1")), "idx", "left").join(tree_depths.select("taxid", F.col("depth").alias("d2")), "taxid", "left")
    origin = F.when(F.col("d1").isNotNull(), "pairs").when(F.col("d2").isNotNull(), "tree").otherwise("default")
    return a.select("idx", F.coalesce("d1", "d2", F.lit(deepest)).cast("int").alias("depth"), origin.alias("origin"))


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the rank of a column's values, ties given their mean. Equal values are counted first, and the running
    sum is over distinct values in ranges, so no task holds all rows."""
    from ..tables import dense_index

    counts = dense_index(df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")), ["_v"], "_i")
    blocks = counts.withColumn("_b", F.floor(F.col("_i") / 4096))
    sums = blocks.groupBy("_b").agg(F.sum("_n").alias("_s"))
    base = sums.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    before = F.col("_base") + F.sum("_n").over(Window.partitionBy("_b").orderBy("_i")) - F.col("_n")
    ranked = blocks.join(F.broadcast(base), "_b").select("_v", (before + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranked, F.col(column).eqNullSafe(F.col("_v"))).drop("_v")


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null where a side is constant (corr would divide by zero)."""
    return F.try_divide(F.covar_pop(x, y), F.when(F.stddev_pop(x) > 1e-12, F.stddev_pop(x)) * F.when(F.stddev_pop(y) > 1e-12, F.stddev_pop(y)))


def depth_norm_correlation(rows: DataFrame) -> DataFrame:
    """One row for rows(depth, norm): pearson (0 where a side is constant), slope and intercept of norm on depth."""
    slope = F.try_divide(F.covar_pop("depth", "norm"), F.var_pop("depth"))
    return rows.agg(F.count("*").alias("n"), F.coalesce(correlation("depth", "norm"), F.lit(0.0)).alias("pearson"), slope.alias("slope"), (F.avg("norm") - slope * F.avg("depth")).alias("intercept"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    both = average_ranks(average_ranks(rows.select(x, y), x, "_rx"), y, "_ry")
    return both.agg(correlation("_rx", "_ry").alias("spearman"))


def correlation_report(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row for the pairs without a null: n, pearson, pearson_p, spearman, spearman_p and, of the former, the verdict."""
    both = average_ranks(average_ranks(rows.select(x, y).dropna(), x, "_rx"), y, "_ry")
    one = both.agg(F.count("*").alias("n"), correlation(x, y).alias("pearson"), correlation("_rx", "_ry").alias("spearman"))
    return one.select("n", "pearson", correlation_p(F.col("pearson"), F.col("n")).alias("pearson_p"), "spearman", correlation_p(F.col("spearman"), F.col("n")).alias("spearman_p"), depth_verdict(F.col("pearson")).alias("verdict"))


def depth_verdict(r: Column) -> Column:
    """How well norms follow depths."""
    return F.when(r > 0.5, "good").when(r > 0.3, "weak").when(r > 0, "poor").when(r.isNotNull(), "broken")


def separation_verdict(ratio: Column) -> Column:
    """How far groups lie apart."""
    return F.when(ratio > 2.0, "excellent").when(ratio > 1.5, "good").when(ratio > 1.2, "moderate").when(ratio.isNotNull(), "poor")


def norm_by_depth(rows: DataFrame) -> DataFrame:
    """(depth, n, least, q1, median, q3, most): quartiles by place among the numbered norms of a depth, interpolated."""
    from .sampling import numbered

    placed = numbered(rows.select("depth", "norm"), ["depth"], ["norm"], "i")
    sizes = rows.groupBy("depth").agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.max("norm").alias("most"))
    want = sizes.select("depth", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), (1 + p * (F.col("n") - 1)).alias("x")) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])).alias("w")).select("depth", "w.*")
    ends = want.select("depth", "c", "x", F.explode(F.array_distinct(F.array(F.floor("x"), F.ceil("x")))).alias("i"))
    hit = placed.join(ends, ["depth", "i"]).groupBy("depth", "c", "x").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    hit = hit.select("depth", "c", (F.col("low") + (F.col("x") - F.floor("x")) * (F.col("high") - F.col("low"))).alias("v"))
    at = hit.groupBy("depth").pivot("c", ["q1", "median", "q3"]).agg(F.first("v"))
    return sizes.join(at, "depth").select("depth", "n", "least", "q1", "median", "q3", "most")


def hierarchy_share(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """Percentage of pairs whose ancestor has the smaller norm."""
    n = norms(emb)
    a = n.select(F.col("idx").alias("ancestor_idx"), F.col("norm").alias("a"))
    d = n.select(F.col("idx").alias("descendant_idx"), F.col("norm").alias("d"))
    return pairs.join(a, "ancestor_idx").join(d, "descendant_idx").agg(F.count("*").alias("n"), (100 * F.avg(F.when(F.col("a") < F.col("d"), 1.0).otherwise(0.0))).alias("hierarchy_pct"))


def hierarchy_share_of_groups(ancestors: DataFrame, descendants: DataFrame, group: str) -> DataFrame:
    """hierarchy_share of all pairs of ancestors(<group>, norm) and descendants(<group>, norm) of one group, without a row a pair.

    Equal norms are counted first; a running sum over both in the order of (group, norm) tells how many ancestors have a smaller one.
    """
    from ..tables import running_total

    part = lambda df, kind: df.where(F.col(group).isNotNull() & F.col("norm").isNotNull()).groupBy(F.col(group).alias("g"), "norm").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    below = F.when(F.col("kind") == 1, F.col("n"))  # of equal norms the descendants come first
    rows = running_total(part(descendants, 0).unionByName(part(ancestors, 1)), ["g", "norm", "kind"], below, "seen")
    sizes = [df.groupBy(F.col(group).alias("g")).agg(F.count("*").alias(name)) for df, name in ((ancestors, "of_a"), (descendants, "of_d"))]
    pairs = sizes[0].join(sizes[1], "g").agg(F.coalesce(F.sum(F.col("of_a") * F.col("of_d")), F.lit(0)).alias("n"))
    # what was seen before a group's rows is the same for all of them
    by = rows.groupBy("g").agg(F.min(F.col("seen") - F.coalesce(below, F.lit(0))).alias("base"), F.sum(F.when(F.col("kind") == 0, F.col("n") * F.col("seen"))).alias("sum"), F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("of_d"))
    hits = by.agg(F.coalesce(F.sum(F.col("sum") - F.col("base") * F.col("of_d")), F.lit(0)).alias("hits"))
    return pairs.join(F.broadcast(hits), F.lit(True)).select("n", F.try_divide(100.0 * F.col("hits"), F.col("n")).alias("hierarchy_pct"))


_poincare_block = rings.poincare_block


def nearest_neighbors(emb: DataFrame, k: int, label: str | None = None, clamped: bool = True, tile: int | None = None) -> DataFrame:
    """(idx, cls, rank, neighbor, neighbor_cls, distance): the k nearest of each row by Poincaré distance.

    The row itself is left out by its idx; ties go to the smaller idx. Rows lie in blocks by their norm, and a block
    reads only those that can hold one of its k nearest (see `rings`); k rows leave the task for each row.
    """
    return rings.nearest_neighbors(emb, k, label, clamped, tile)


def knn_purity(emb: DataFrame, label: str, k: int = 10) -> DataFrame:
    """One row: share of the k nearest neighbours that have the row's class; rows without a class take no part."""
    near = nearest_neighbors(emb.where(F.col(label).isNotNull()), k, label)
    same = (F.col("cls") == F.col("neighbor_cls")).cast("double")
    return near.agg(F.count("*").alias("n"), F.coalesce(F.avg(same), F.lit(0.0)).alias("purity"))


def distance_sums(emb: DataFrame, label: str, tile: int | None = None, width: float = 1.0, bins: int = 64, clamped: bool = True) -> DataFrame:
    """(same, bin, n, total, squares) of all ordered pairs of different rows, summed within each block of distances.

    All pairs are n^2 by nature; a pair costs a matrix product once for both orders, and a task holds two blocks (see `rings.pair_sums`).
    """
    part = rings.pair_sums(emb, label, width, bins, clamped, tile)
    return part.groupBy("same", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def class_separation(emb: DataFrame, label: str) -> DataFrame:
    """One row: means and deviations of distances within and between classes, and their ratio (0 without either)."""
    s, n = F.sum, F.col("n")
    pick = lambda c, same: F.coalesce(s(F.when(F.col("same") == same, F.col(c))), F.lit(0))
    one = distance_sums(emb, label, bins=1).agg(*[pick(c, k).alias(f"{c}_{'intra' if k else 'inter'}") for c in ("n", "total", "squares") for k in (True, False)])
    mean = lambda k: F.try_divide(f"total_{k}", f"n_{k}")
    dev = lambda k: F.sqrt(F.greatest(F.try_divide(f"squares_{k}", f"n_{k}") - mean(k) * mean(k), F.lit(0.0)))
    return one.select(
        F.col("n_intra").cast("long").alias("n_intra"), F.col("n_inter").cast("long").alias("n_inter"), mean("intra").alias("mean_intra"), mean("inter").alias("mean_inter"), dev("intra").alias("std_intra"), dev("inter").alias("std_inter"),
        F.coalesce(mean("inter") / (mean("intra") + 1e-8), F.lit(0.0)).alias("ratio"),
    )


def distance_histogram(emb: DataFrame, label: str, width: float = 0.25, bins: int = 64) -> DataFrame:
    return distance_sums(emb, label, width=width, bins=bins).select("same", "bin", "n")


def group_pairs(rows: DataFrame, group: str, within: int = 20, across: int = 10, cap: int = 100, least: int = 10, seed: int = 1, metric: str = "poincare") -> DataFrame:
    """(same, d): distances of bounded pairs, as for reports: at most `cap` rows of each group with
    `least` or more; each row meets the next `within` - 1 of its group, each group's first row those of the
    next `across` - 1 groups."""
    from .sampling import capped_sample

    big = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    number = big.select(F.col(group).alias("_g"), F.row_number().over(Window.orderBy(group)).alias("g"))  # a row a group
    s = capped_sample(rows, [group], cap, seed, ["idx"]).join(number, F.col(group) == F.col("_g"))
    s = s.select("g", "idx", "vec", F.row_number().over(Window.partitionBy("g").orderBy("idx")).alias("i"))
    a, b = s.alias("a"), s.alias("b")
    d = V.poincare_distance(F.col("a.vec"), F.col("b.vec")) if metric == "poincare" else F.sqrt(V.squared_distance(F.col("a.vec"), F.col("b.vec")))
    near = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("b.i") > F.col("a.i")) & (F.col("b.i") < F.col("a.i") + within)).select(F.lit(True).alias("same"), d.alias("d"))
    heads = s.where("i = 1").select((F.explode(F.sequence(F.col("g") + 1, F.col("g") + across - 1))).alias("to"), "vec", "g")
    far = heads.alias("a").join(s.where("i = 1").alias("b"), F.col("a.to") == F.col("b.g")).select(F.lit(False).alias("same"), d.alias("d"))
    return near.unionByName(far)


def group_distances(pairs: DataFrame) -> DataFrame:
    """One row for pairs(same, d): means, deviations, their ratio, and the share of intra distances above the median inter one."""
    both = pairs
    intra, inter = F.when(F.col("same"), F.col("d")), F.when(~F.col("same"), F.col("d"))
    return both.agg(F.count(intra).alias("n_intra"), F.count(inter).alias("n_inter"), F.avg(intra).alias("mean_intra"), F.avg(inter).alias("mean_inter"), F.stddev_pop(intra).alias("std_intra"), F.stddev_pop(inter).alias("std_inter"), F.try_divide(F.avg(inter), F.avg(intra)).alias("ratio"))


def overlap_share(pairs: DataFrame) -> DataFrame:
    """One row for pairs(same, d): the percentage of intra distances above the median of the inter distances."""
    middle = percentiles(pairs.where(~F.col("same")), "d", [0.5]).select(F.col("value").alias("median"))
    return pairs.where("same").join(F.broadcast(middle), F.lit(True)).agg(F.max("median").alias("median"), (100 * F.avg((F.col("d") > F.col("median")).cast("double"))).alias("overlap_pct"))


def reconstruction(adjacent: DataFrame, emb: DataFrame, tile: int | None = None) -> DataFrame:
    """(source, n, mean_rank, ap) for adjacent(source, target): the rank of each target among the non-targets by distance.

    A target's rank is 1 + the non-targets that are nearer; the average precision runs over the targets in
    order; ties go to the smaller idx. See `rings.link_places` for how vectors are counted.
    """
    place = rings.link_places(adjacent, emb, tile)
    seen = place.withColumn("found", F.row_number().over(Window.partitionBy("source").orderBy("place", "target")))  # a source's own links
    return seen.groupBy("source").agg(F.count("*").alias("n"), F.avg(F.col("place") - F.col("found") + 1).alias("mean_rank"), F.avg(F.col("found") / F.col("place")).alias("ap"))


def reconstruction_of_classes(emb: DataFrame, label: str, tile: int | None = None) -> DataFrame:
    """(source, n, mean_rank, ap) as `reconstruction` gives them where every vector is linked to all others of its class.

    The links, n^2 of them, are never rows. Vectors without a class are no sources, but compete; a vector alone in its class has no row.
    """
    return rings.class_places(emb, label, tile)


def rank_clustering(emb: DataFrame, groups: DataFrame, metric: str = "poincare") -> DataFrame:
    """One row: distances within and between the groups(idx, group), as group_distances, and a verdict on their ratio.

    `euclid` takes straight distances. Without distances of either kind the ratio is null and the verdict N/A.
    """
    d = group_distances(group_pairs(emb.join(groups.where("group is not null"), "idx"), "group", metric=metric))
    r = F.col("ratio")
    return d.withColumn("verdict", F.when(r > 2.0, "excellent").when(r > 1.5, "good").when(r > 1.2, "moderate").when(r.isNotNull(), "weak").otherwise("N/A"))


def multiscale_knn(emb: DataFrame, paths: DataFrame, depths, k: int = 10) -> DataFrame:
    """(depth, n, purity): share of the k nearest neighbours with the row's ancestor at each depth, for paths(idx, path).

    Neighbours are found once; rows or neighbours above a depth take no part in it.
    """
    near = nearest_neighbors(emb, k).select("idx", "neighbor")
    own = paths.select("idx", "path")
    both = near.join(own, "idx").join(own.select(F.col("idx").alias("neighbor"), F.col("path").alias("other")), "neighbor")
    at = both.select(F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth"), "path", "other")
    a, b = F.get("path", F.col("depth")), F.get("other", F.col("depth"))
    return at.where(a.isNotNull() & b.isNotNull()).groupBy("depth").agg(F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("purity"))


def euclidean_neighbors(emb: DataFrame, idx: int, k: int) -> DataFrame:
    """(idx, distance): the k rows nearest to one row by straight distance, ties to the smaller idx; itself left out."""
    one = emb.where(F.col("idx") == idx).select(F.col("vec").alias("_q")).limit(1)
    d = F.sqrt(V.squared_distance(F.col("vec"), F.col("_q")))
    return emb.where(F.col("idx") != idx).join(F.broadcast(one), F.lit(True)).select("idx", d.alias("distance")).orderBy("distance", "idx").limit(k)


def histogram(rows: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n) of equal bins from 0 to the largest value, which falls into the last one."""
    top = rows.agg(F.max(column).alias("_top"))
    at = F.least(F.floor(F.col(column) / F.col("_top") * bins), F.lit(bins - 1)).cast("int")
    return rows.join(F.broadcast(top), F.lit(True)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))


def norm_by_quartile(rows: DataFrame) -> DataFrame:
    """(quartile, n, least, mean, most) of the norms in rows(depth, norm), by quartile of depth."""
    q = percentiles(rows, "depth", (0.25, 0.5, 0.75)).agg(F.min("value").alias("q1"), F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("q2"), F.max("value").alias("q3"))
    part = F.when(F.col("depth") <= F.col("q1"), 1).when(F.col("depth") <= F.col("q2"), 2).when(F.col("depth") <= F.col("q3"), 3).otherwise(4)
    return rows.join(F.broadcast(q), F.lit(True)).groupBy(part.alias("quartile")).agg(F.count("*").alias("n"), F.min("norm").alias("least"), F.avg("norm").alias("mean"), F.max("norm").alias("most"))


def distance_summary(pairs: DataFrame) -> DataFrame:
    """(same, n, least, median, most) of pairs(same, d)."""
    middle = None
    for same in (True, False):
        one = percentiles(pairs.where(F.col("same") == same), "d", [0.5]).select(F.lit(same).alias("_same"), F.col("value").alias("median"))
        middle = one if middle is None else middle.unionByName(one)
    by = pairs.groupBy("same").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
    return by.join(F.broadcast(middle), F.col("same") == F.col("_same")).select("same", "n", "least", "median", "most")


def largest_groups(rows: DataFrame, by: str, n: int) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def shares(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, pct) of all rows."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_all"))), F.lit(True)).select(by, "n", (100.0 * F.col("n") / F.col("_all")).alias("pct"))


def compare_histories(clean: DataFrame, dirty: DataFrame) -> DataFrame:
    """(epoch, clean, dirty, delta, delta_pct) of the losses of two histories(epoch, loss); an epoch of one alone has nulls."""
    both = clean.select("epoch", F.col("loss").alias("clean")).join(dirty.select("epoch", F.col("loss").alias("dirty")), "epoch", "full")
    return both.select("epoch", "clean", "dirty", (F.col("clean") - F.col("dirty")).alias("delta"), F.try_divide(100 * (F.col("clean") - F.col("dirty")), F.col("dirty")).alias("delta_pct"))


def covariance(emb: DataFrame) -> DataFrame:
    """(i, j, n, c): the covariance of each pair of coordinates of emb(vec); null for one vector.

    The products of coordinates are summed in each task (dim^2 numbers), so no pair of columns is shuffled.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        n, s, p = 0, None, None
        for b in batches:
            m = np.array(b.column("vec").to_pylist(), float)
            if len(m):
                n, s, p = n + len(m), m.sum(0) + (0 if s is None else s), m.T @ m + (0 if p is None else p)
        if n:
            d = len(s)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(np.full(d * d, n, "int64")), pa.array(s[i]), pa.array(s[j]), pa.array(p.ravel())], ["i", "j", "n", "si", "sj", "p"])

    part = emb.select("vec").mapInArrow(run, "i int, j int, n long, si double, sj double, p double")
    c = part.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("si").alias("si"), F.sum("sj").alias("sj"), F.sum("p").alias("p"))
    return c.select("i", "j", "n", F.try_divide(F.col("p") - F.col("si") * F.col("sj") / F.col("n"), F.col("n") - 1).alias("c"))


def participation_ratio(emb: DataFrame) -> DataFrame:
    """One row: (sum of eigenvalues)^2 / sum of their squares of the covariance, as trace(C)^2 / |C|_F^2."""
    c = covariance(emb)
    trace = F.sum(F.when(F.col("i") == F.col("j"), F.col("c")))
    return c.agg(F.max("n").alias("n"), F.when(F.max("n") < 2, F.sqrt(F.count("*").cast("double"))).otherwise(F.try_divide(trace * trace, F.sum(F.col("c") * F.col("c")))).alias("participation_ratio"))


def packing_dimension(n: int, max_cosine: float = 0.3) -> int:
    if max_cosine <= 0:
        raise ValueError("max_cosine must be positive")
    return 1 if n <= 1 else math.ceil(2 * math.log(n) / max_cosine**2)


def recommended_dimension(n: int, low: int = 10, high: int = 200, max_cosine: float = 0.3) -> int:
    return min(max(packing_dimension(n, max_cosine), low), high)


def packing_dimension_column(n: Column, max_cosine: float = 0.3) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.ceil(2 * F.ln(n.cast("double")) / F.lit(max_cosine**2))).cast("int")


def class_weights(labels: DataFrame, most: float = 10.0) -> DataFrame:
    """(class, n, weight): sqrt of the largest class over the own, at most `most`."""
    counts = labels.groupBy("class").agg(F.count("*").alias("n"))
    top = counts.agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), F.lit(True)).select("class", "n", F.least(F.sqrt(F.col("top") / F.col("n")), F.lit(most)).alias("weight"))


def improvement(history: DataFrame) -> DataFrame:
    """history(epoch, loss) with the change to the epoch before, the best so far and its epoch. A row an epoch: few."""
    w = Window.orderBy("epoch")
    prev = F.lag("loss").over(w)
    best = F.min(F.struct("loss", "epoch")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return history.select("epoch", "loss", (F.col("loss") - prev).alias("delta"), (100 * (F.col("loss") - prev) / prev).alias("delta_pct"), best["loss"].alias("best"), best["epoch"].alias("best_epoch"))
