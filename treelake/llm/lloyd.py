"""Centroid clustering of whole-number vectors by plain Lloyd rounds, exact in every step."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import MAX_LONG, Scratch

#: Differences of components below twice this, squared and summed over 64 of them, fit in a long.
SMALL = 1 << 27
ROWS = 1024


def on_grid(vectors: DataFrame, dim: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component x as double, for vectors of exactly `dim` sound components.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. What a
    long can't hold becomes the nearest long. Null ids stay.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def seed_order(seed: str) -> Column:
    """Lowercase hex sha256 of `seed:vec_id`; null for a null id."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def nearest(m, centroids):
    """(number, squared distance) of the nearest centroid of each row of m; ties go to the lowest number. Exact: beyond
    SMALL Python's integers stand in, and a distance that a long can't hold becomes the largest long."""
    import numpy as np

    small = max(abs(int(f(x))) for x in (m, centroids) for f in (np.min, np.max)) < SMALL and m.shape[1] <= 64
    if not small:
        m, centroids = m.astype(object), centroids.astype(object)
    at, best = np.zeros(len(m), np.int32), None
    for j, c in enumerate(centroids):
        d = m - c
        d = np.einsum("ij,ij->i", d, d) if small else (d * d).sum(1)
        closer = np.ones(len(m), bool) if best is None else (d < best)
        at[closer] = j
        best = d if best is None else np.where(closer, d, best)
    return at, best if small else np.array([min(x, MAX_LONG) for x in best], np.int64)


def _pieces(frames: Iterator) -> Iterator[tuple]:
    """(ids, matrix) of a few rows of pandas frames (vec_id, v) at a time."""
    import numpy as np

    for f in frames:
        for at in range(0, len(f), ROWS):
            part = f.iloc[at : at + ROWS]
            yield part["vec_id"], np.stack(part["v"].to_numpy()).astype(np.int64)


def _sums(vectors: DataFrame, centroids) -> DataFrame:
    """(cluster, place, n, total): how many vectors each centroid gets and the sums of their components."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        c = shared.value
        counts, totals = [0] * len(c), [[0] * c.shape[1] for _ in c]
        for _, m in _pieces(frames):
            at, _ = nearest(m, c)
            exact = m if int(np.abs(m.astype(float)).max()) < 1 << 52 else m.astype(object)  # sums of ROWS such numbers fit in a long
            for j in np.unique(at):
                own = exact[at == j]
                counts[j] += len(own)
                totals[j] = [a + int(b) for a, b in zip(totals[j], own.sum(0))]
        yield pd.DataFrame([(j, i, n, Decimal(x)) for j, n in enumerate(counts) if n for i, x in enumerate(totals[j])], columns=["cluster", "place", "n", "total"])

    each = vectors.mapInPandas(run, "cluster int, place int, n long, total decimal(38,0)")
    return each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fit_centroids(vectors: DataFrame, k: int, rounds: int, seed: str):
    """The k centroids, as a matrix of whole numbers, after `rounds` rounds; fewer rows if there are fewer vectors.

    They start as the vectors that come first in seed_order, null ids last, rows of one id by their
    components. Each round replaces every centroid that has vectors by the floor of their mean, and leaves
    the others. The driver holds k centroids and their k sums, whatever the number of vectors.
    """
    import numpy as np

    first = vectors.orderBy(seed_order(seed).asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first] or np.zeros((0, 0)), np.int64)
    for _ in range(rounds if first else 0):
        for r in _sums(vectors, centroids).collect():
            centroids[r.cluster, r.place] = int(r.total) // r.n
    return centroids


def lloyd_clusters(spark: SparkSession, vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for every row of vectors(vec_id, v) from `on_grid`.

    centroid is the final one of the row's cluster. The inertias are sums of squared distances, over the
    cluster and over all. Vectors stay in their tasks: a round broadcasts k centroids, k times `dim` numbers,
    and a task returns k sums of `dim` integers, which merge by groupBy, so no cluster is ever in one place
    and one that holds most vectors costs no more than others. Every number is whole and exact, so neither
    order nor partitions matter. Repeated rows count as often as they come; null ids take part like others
    and come back null; ties go to the lower number; an empty table gives an empty one. Sums beyond a long
    become the largest long.
    """
    scratch = Scratch(spark, "lloyd")
    vectors = scratch.save(vectors.select("vec_id", "v"), "vectors")
    centroids = fit_centroids(vectors, k, rounds, seed)
    shared = spark.sparkContext.broadcast(centroids)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for ids, m in _pieces(frames):
            at, distance = nearest(m, shared.value)
            yield pd.DataFrame({"vec_id": ids.astype("Int64"), "cluster": at, "distance": distance})

    assigned = scratch.save(vectors.mapInPandas(run, "vec_id long, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    whole = sum(int(r.s) for r in sums)
    rows = [(r.cluster, min(int(r.s), MAX_LONG), min(whole, MAX_LONG), [int(x) for x in centroids[r.cluster]]) for r in sums]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
