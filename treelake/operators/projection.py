"""Two coordinates of vectors that respect the ball: the Fréchet mean, tangent vectors there, and their main axes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import sampling
from .metrics import covariance

TINY = 1e-12


def moebius_add(x, y):
    """The sum of points of the ball, row by row."""
    xy, xx, yy = ((a * b).sum(1, keepdims=True) for a, b in ((x, y), (x, x), (y, y)))
    return ((1 + 2 * xy + yy) * x + (1 - xx) * y) / (1 + 2 * xy + xx * yy)


def log_at(base, x):
    """The tangent vectors at `base` that lead to the rows of x; their length is half the distance times 1 - |base|^2."""
    import numpy as np

    y = moebius_add(-base[None], x)
    n = np.maximum(np.linalg.norm(y, axis=1, keepdims=True), TINY)
    return y * ((1 - base @ base) * np.arctanh(np.minimum(n, 1 - TINY)) / n)


def exp_at(base, v):
    """Where the tangent vector v at `base` leads."""
    import numpy as np

    n = max(float(np.linalg.norm(v)), TINY)
    return moebius_add(base[None], (v * np.tanh(n / (1 - base @ base)) / n)[None])[0]


def tangents(emb: DataFrame, at: list[float]) -> DataFrame:
    """emb(vec, ...) with vec replaced by its tangent vector at the point."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                t = log_at(np.array(at), b.column("vec").flatten().to_numpy().reshape(b.num_rows, -1))
                ends = pa.array(np.arange(0, t.size + 1, t.shape[1]), pa.int32())
                place = b.schema.get_field_index("vec")
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, t.ravel()) if k == place else c for k, c in enumerate(b.columns)], b.schema.names)

    rows = emb.withColumn("vec", F.col("vec").cast("array<double>"))
    return rows.mapInArrow(run, rows.schema)


def frechet_mean(emb: DataFrame, rounds: int = 20, close: float = 1e-9) -> list[float]:
    """The point of least squared distances to all of emb(vec): each round goes along the mean of the tangent vectors, one
    aggregate of `dim` numbers; ends after `rounds`, or when a step is shorter than `close`. Empty for no vectors."""
    import numpy as np

    first = emb.select(F.size("vec").alias("d")).first()
    at = np.zeros(first.d if first else 0)
    for _ in range(rounds if first else 0):
        mean = np.array(tangents(emb.select("vec"), at.tolist()).agg(*[F.avg(F.get("vec", F.lit(k))) for k in range(len(at))]).first())
        at = exp_at(at, mean)
        if np.linalg.norm(mean) < close:
            break
    return at.tolist()


def _point(numbers: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in numbers])


def project(emb: DataFrame, metric: str = "poincare", rounds: int = 20) -> DataFrame:
    """emb(idx, vec, ...) with x and y in place of vec: the two main components of its tangent vectors at the Fréchet mean, or of
    the vectors less their mean for metric "euclidean". The axis' largest number is positive, so that a repeat gives the same."""
    import numpy as np

    flat = tangents(emb, frechet_mean(emb, rounds)) if metric == "poincare" else emb
    cells = {(r.i, r.j): r.c or 0.0 for r in covariance(flat).collect()}  # dim * dim numbers
    d = 1 + max((i for i, _ in cells), default=-1)
    if not d:
        return emb.select(*[c for c in emb.columns if c != "vec"], F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    c = np.array([[cells[i, j] for j in range(d)] for i in range(d)])
    _, axes = np.linalg.eigh(c)
    axes = [a if a[np.abs(a).argmax()] > 0 else -a for a in (axes[:, -1], axes[:, -2] if d > 1 else np.zeros(d))]
    centre = flat.agg(*[F.avg(F.get("vec", F.lit(k))) for k in range(d)]).first()
    along = lambda a: V.dot(F.col("vec"), _point(a.tolist())) - float(sum(a * [x or 0.0 for x in centre]))
    return flat.select(*[c for c in emb.columns if c != "vec"], *[along(a).alias(n) for a, n in zip(axes, "xy")])


def picture(emb: DataFrame, labels: DataFrame, sample: int = 0, only: bool = False, trained: DataFrame | None = None, metric: str = "poincare", seed: int = 7, default: str = "Other") -> DataFrame:
    """(idx, label, x, y): what a picture of emb(idx, vec) shows, with a colour for each label of labels(idx, label).

    sample: so many points, in proportion to the labels (0: all). only: without the points of no label. trained(idx): only
    points that a training touched. The axes are those of the points shown.
    """
    rows = emb.join(labels.select("idx", "label").where(F.col("label") != default), "idx", "left").withColumn("label", F.coalesce("label", F.lit(default)))
    if only:
        rows = rows.where(F.col("label") != default)
    if trained is not None:
        rows = rows.join(trained.select("idx").distinct(), "idx", "left_semi")
    if sample:
        rows = sampling.proportional_sample(rows, "label", sample, seed, ["idx"])
    return project(rows.select("idx", "label", "vec"), metric)
