"""Training steps on the given vectors, each with SQL that takes the same step in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import blocks as B
from ..operators import pairs as P
from ..operators import projection as R
from ..operators import training as L
from ..operators import tree as T
from ..tables import saved
from .queries import EMB, query
from .trees import VECTORS_SQL, geo, scaled_vectors

#: Negatives of the link from vector i to i + 1: those this far on, around the end.
STEPS = (2, 5, 11)
MARGIN, RATE, RADIAL, CONE_MARGIN = 0.4, 0.3, 0.05, 0.6
WIDTH = 64

_N = "(SELECT max(idx) + 1 FROM emb)"
_LINKS = f"""n AS (SELECT count(*) AS links FROM emb), l AS (SELECT e.idx AS i, e.vec AS u, o.idx AS j, o.vec AS v, k.k, 1.0 / n.links AS w FROM emb e, n, (VALUES (1), {', '.join(f'({k})' for k in STEPS)}) k(k) JOIN emb o ON o.idx = (e.idx + k.k) % {_N})"""
#: d(u, v), its slope, and what of u and v each end's gradient takes.
_POINCARE = f"""{VECTORS_SQL}, {_LINKS}, q AS (SELECT *, list_inner_product(u, u) AS a, list_inner_product(v, v) AS b, list_distance(u, v) ** 2 AS s FROM l), x AS (SELECT *, (1 - a) * (1 - b) + 1e-5 AS bottom, 1 + 2 * s / ((1 - a) * (1 - b) + 1e-5) + 1e-5 AS x FROM q),
d AS (SELECT *, acosh(x) AS d, 2 / (bottom * sqrt(x * x - 1)) AS slope FROM x)"""
_HINGE = f"""p AS (SELECT i, d AS near FROM d WHERE k = 1), gap AS (SELECT d.i, d.k, greatest(near - d + {MARGIN}, 0) AS gap FROM d JOIN p ON p.i = d.i WHERE k > 1),
c AS (SELECT i, k, -CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END / {len(STEPS)} AS c FROM gap UNION ALL SELECT i, 1, avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END) FROM gap GROUP BY i),
part AS (SELECT i AS idx, u AS own, v AS other, w * c * slope * (2 + 2 * s * (1 - b) / bottom) AS mine, -2 * w * c * slope AS theirs FROM d JOIN c USING (i, k) UNION ALL SELECT j, v, u, w * c * slope * (2 + 2 * s * (1 - a) / bottom), -2 * w * c * slope FROM d JOIN c USING (i, k)),
g AS (SELECT idx, r, sum(mine * own[r] + theirs * other[r]) AS g FROM part, range(1, {WIDTH + 1}) t(r) GROUP BY idx, r)"""
_GRADIENT = f"WITH {_POINCARE}, {_HINGE}"


def _shown(table: str, value: str) -> str:
    return f"SELECT idx, round(max({value}) FILTER (r = 1), 6) AS x0, round(max({value}) FILTER (r = 2), 6) AS x1, round(sqrt(sum({value} * {value})), 6) AS norm FROM {table} GROUP BY idx"


def _show(rows, column: str):
    """(idx, x0, x1, norm) of rows(idx, <column>)."""
    return rows.select("idx", *[F.round(F.get(column, F.lit(k)), 6).alias(f"x{k}") for k in (0, 1)], F.round(V.norm(F.col(column)), 6).alias("norm"))


def _links(spark, sf_dir, margin: float):
    """Vectors, links with their negatives, and the packed blocks of the vectors; small blocks, so that links cross them."""
    e = scaled_vectors(spark, sf_dir).select("idx", "vec", "depth")
    one = F.broadcast(e.agg((F.max("idx") + 1).alias("n"), F.count("*").alias("links")))
    at = lambda k: F.pmod(F.col("idx") + k, F.col("n")).cast("int")
    links = e.join(one, F.lit(True)).select(F.col("idx").cast("int").alias("ancestor_idx"), at(1).alias("descendant_idx"), F.array(*[at(k) for k in STEPS]).alias("negatives"), F.lit(margin).alias("margin"), (1.0 / F.col("links")).alias("weight"))
    return e, saved(links, "links"), B.rows_of_block(1 << 12)


def _start(e, size, manifold="poincare"):
    target = V.target_radius(F.col("depth").cast("double"), F.lit(4.0))
    return saved(L.start_blocks(e.select("idx", target.alias("target"), F.array(F.lit(0).cast("long")).alias("pools"), "vec"), size, manifold), "state")


def _gradients(spark, sf_dir, loss="ranking", manifold="poincare", margin=MARGIN):
    e, links, size = _links(spark, sf_dir, margin)
    state = _start(e, size, manifold)
    return state, saved(B.block_gradients(links, state, manifold, loss, size=size), "grads"), size


def _rows(grads, size, width=WIDTH):
    return B.gradient_rows(grads.where(F.octet_length("place") > 0), width).select((F.col("block").cast("long") * size + F.col("place")).alias("idx"), "g")


@query(f"{_GRADIENT} {_shown('g', 'g')}")
def ranking_gradients(spark, sf_dir):
    """The gradient of the mean ranking loss by every vector, from blocks that links cross."""
    _, grads, size = _gradients(spark, sf_dir)
    return _show(_rows(grads, size), "g")


@query(f"{_GRADIENT} SELECT (SELECT count(*) FROM emb) AS links, round(sum(gap) / {len(STEPS)} / (SELECT count(*) FROM emb), 6) AS loss FROM gap")
def ranking_loss(spark, sf_dir):
    return _gradients(spark, sf_dir)[1].agg(F.sum("n").alias("links"), F.round(F.sum("loss"), 6).alias("loss"))


@query(f"{_GRADIENT}, step AS (SELECT e.idx, r, e.vec[r] - {RATE * 100} * pow(1 - list_inner_product(e.vec, e.vec), 2) / 4 * g AS y FROM g JOIN emb e ON e.idx = g.idx), size AS (SELECT idx, sqrt(sum(y * y)) AS n FROM step GROUP BY idx), held AS (SELECT idx, r, CASE WHEN n >= 0.999 THEN y * (0.999 / (n + 1e-8)) ELSE y END AS y FROM step JOIN size USING (idx)) {_shown('held', 'y')}")
def riemannian_descent_step(spark, sf_dir):
    """A step of Riemannian gradient descent that writes touched blocks only."""
    state, grads, _ = _gradients(spark, sf_dir)
    versions = B.Versions(state)
    B.descend(versions, grads, RATE * 100)
    return _show(L.ball_vectors(versions.current()), "vec")


def _adam_sql(metric: str) -> str:
    pull = f"2 * {RADIAL} / (SELECT count(*) FROM emb) * (sqrt(list_inner_product(e.vec, e.vec)) - (0.1 + 0.85 * (e.depth / 4.0))) / sqrt(list_inner_product(e.vec, e.vec)) * e.vec[r]"
    return f"""{_GRADIENT}, whole AS (SELECT e.idx, r, e.vec[r] AS y, (g + {pull}){metric} AS g FROM g JOIN emb e ON e.idx = g.idx), clip AS (SELECT least(1, 1 / (sqrt(sum(g * g)) + 1e-6)) AS c FROM whole),
step AS (SELECT idx, r, y - {RATE / 10} * (g * c) / (abs(g * c) + 1e-8) AS y FROM whole, clip), size AS (SELECT idx, sqrt(sum(y * y)) AS n FROM step GROUP BY idx), held AS (SELECT idx, r, CASE WHEN n >= 0.999 THEN y * (0.999 / (n + 1e-8)) ELSE y END AS y FROM step JOIN size USING (idx))
SELECT idx, round(sqrt(sum(y * y)), 4) AS norm FROM held GROUP BY idx"""


def _adam(spark, sf_dir, riemannian):
    state, grads, _ = _gradients(spark, sf_dir)
    n = scaled_vectors(spark, sf_dir).count()
    moved, *_ = B.adam_blocks(state, grads, 1, RATE / 10, RADIAL, n, riemannian=riemannian)
    return L.ball_vectors(moved).select("idx", F.round(V.norm(F.col("vec")), 4).alias("norm"))


@query(_adam_sql(""))
def adam_first_step(spark, sf_dir):
    """Radial pull, clip by the global norm, and Adam's first step."""
    return _adam(spark, sf_dir, False)


@query(_adam_sql(" * pow(1 - list_inner_product(e.vec, e.vec), 2) / 4"))
def riemannian_adam_first_step(spark, sf_dir):
    return _adam(spark, sf_dir, True)


_LIFT = "list_concat([(1 + list_inner_product({0}, {0})) / (1 - list_inner_product({0}, {0}))], list_transform({0}, lambda c: 2 * c / (1 - list_inner_product({0}, {0}))))"


@query(f"""WITH {VECTORS_SQL}, {_LINKS}, y AS (SELECT i, j, k, w, {_LIFT.format('u')} AS u, {_LIFT.format('v')} AS v FROM l), x AS (SELECT *, greatest(2 * u[1] * v[1] - list_inner_product(u, v), 1) AS x FROM y), d AS (SELECT *, acosh(x) AS d, -1 / sqrt(greatest(x * x - 1, 1e-5)) AS slope FROM x),
t AS (SELECT i, ln(sum(exp(-d))) AS total FROM d GROUP BY i), c AS (SELECT d.*, (CASE WHEN k = 1 THEN 1 ELSE 0 END - exp(-d - total)) * w * slope AS c FROM d JOIN t USING (i)),
part AS (SELECT i AS idx, v AS other, c FROM c UNION ALL SELECT j, u, c FROM c), g AS (SELECT idx, r, sum(c * other[r] * CASE WHEN r = 1 THEN -1 ELSE 1 END) AS g FROM part, range(1, {WIDTH + 2}) t(r) GROUP BY idx, r) {_shown('g', 'g')}""")
def lorentz_softmax_gradients(spark, sf_dir):
    """The gradient of the cross entropy of distances on the hyperboloid."""
    _, grads, size = _gradients(spark, sf_dir, "softmax", "lorentz")
    return _show(_rows(grads, size, WIDTH + 1), "g")


_A2, _B2, _UV2, _S2 = "list_inner_product(g, g)", "list_inner_product(h, h)", "list_inner_product(g, h)", "pow(list_distance(g, h), 2)"
_HELD2 = "least(greatest({}, -1 + 1e-5), 1 - 1e-5)"
_ANGLE2 = "acos(" + _HELD2.format(f"({_UV2} * (1 + {_A2}) - {_A2} * (1 + {_B2})) / (sqrt({_A2}) * sqrt({_S2}) * sqrt(1 + {_A2} * {_B2} - 2 * {_UV2}))") + ")"
_APERTURE2 = "asin(" + _HELD2.format(f"(0.2 / (1 + sqrt(1.04))) * (1 - {_A2}) / sqrt({_A2})") + ")"


@query(f"WITH {VECTORS_SQL}, {_LINKS}, o AS (SELECT i, k, w, j FROM l), z AS (SELECT o.i, o.k, o.w, CASE WHEN k = 1 THEN a.vec ELSE b.vec END AS g, CASE WHEN k = 1 THEN b.vec ELSE d.vec END AS h FROM o JOIN emb a ON a.idx = o.i JOIN emb b ON b.idx = o.j JOIN emb d ON d.idx = (o.i + 1) % {_N}), e AS (SELECT k, w, greatest({_ANGLE2} - {_APERTURE2}, 0) AS e FROM z) SELECT round(sum(w * CASE WHEN k = 1 THEN e ELSE greatest({CONE_MARGIN} - e, 0) END) / {1 + len(STEPS)}, 6) AS loss FROM e")
def cone_loss(spark, sf_dir):
    """The two-sided hinge of cone energies over all links."""
    return _gradients(spark, sf_dir, "cones", "poincare", CONE_MARGIN)[1].agg(F.round(F.sum("loss"), 6).alias("loss"))


@query(f"{EMB} SELECT idx, round(0.1 + 0.85 * (depth / 4.0), 6) AS norm FROM norms")
def depth_aware_start(spark, sf_dir):
    e = scaled_vectors(spark, sf_dir).select("idx", "depth")
    return L.initial_vectors(e, 12, 4).select("idx", F.round(V.norm(F.col("vec")), 6).alias("norm"))


@query(None)
def train_epoch(spark, sf_dir):
    """An epoch over all pairs of the tree of regions, nations and customers, 10 dimensions: (idx, vec)."""
    nodes = geo(spark, sf_dir, False)
    paths = T.node_paths(T.edges_of(nodes), 1)
    mapping = P.dense_mapping(nodes)
    table = saved(P.pair_table(paths, mapping), "pairs")
    vectors, _ = L.train(table, saved(L.node_table(paths, mapping), "nodes"), L.Options(dim=10, epochs=1, curriculum=False))
    return vectors


# ---------------------------------------------------------------- pictures


def _moebius_sql(x: str, y: str) -> str:
    xy, xx, yy = f"list_inner_product({x}, {y})", f"list_inner_product({x}, {x})", f"list_inner_product({y}, {y})"
    return f"list_transform(range(1, {WIDTH + 1}), lambda r: ((1 + 2 * {xy} + {yy}) * {x}[r] + (1 - {xx}) * {y}[r]) / (1 + 2 * {xy} + {xx} * {yy}))"


def _mean_sql(rounds: int) -> str:
    """The mean after some rounds of logarithm, average and exponential map, from the origin on."""
    out = [f"m0 AS (SELECT [{', '.join(['0.0'] * WIDTH)}] AS m)"]
    for k in range(rounds + 1):
        out.append(f"y{k} AS (SELECT idx, m, {_moebius_sql('n', 'vec')} AS y FROM (SELECT idx, vec, m, list_transform(m, lambda c: -c) AS n FROM emb, m{k}))")
        out.append(f"t{k} AS MATERIALIZED (SELECT idx, m, list_transform(y, lambda c: c * (1 - list_inner_product(m, m)) * atanh(sqrt(list_inner_product(y, y))) / greatest(sqrt(list_inner_product(y, y)), 1e-12)) AS t FROM y{k})")
        if k < rounds:
            out.append(f"a{k} AS (SELECT max(m) AS m, list(v ORDER BY r) AS v FROM (SELECT r, avg(t[r]) AS v, max(m) AS m FROM t{k}, range(1, {WIDTH + 1}) r(r) GROUP BY r))")
            out.append(f"e{k} AS (SELECT m, list_transform(v, lambda c: c * tanh(sqrt(list_inner_product(v, v)) / (1 - list_inner_product(m, m))) / sqrt(list_inner_product(v, v))) AS s FROM a{k})")
            out.append(f"m{k + 1} AS MATERIALIZED (SELECT {_moebius_sql('m', 's')} AS m FROM e{k})")
    return ", ".join(out)


@query(f"WITH {VECTORS_SQL}, {_mean_sql(2)} SELECT idx, round(t[1], 6) AS x0, round(t[2], 6) AS x1, round(sqrt(list_inner_product(t, t)), 6) AS norm FROM t2")
def tangents_at_mean(spark, sf_dir):
    """Tangent vectors at the Fréchet mean after two rounds."""
    e = scaled_vectors(spark, sf_dir).select("idx", "vec")
    return _show(R.tangents(e, R.frechet_mean(e, 2)), "vec")


@query(f"{EMB}, p AS (SELECT idx, CASE WHEN class IN (1, 2) THEN CAST(class AS VARCHAR) ELSE 'Other' END AS label FROM emb WHERE idx % 2 = 0) SELECT label, count(*) AS n FROM p WHERE label <> 'Other' GROUP BY label")
def points_of_picture(spark, sf_dir):
    """Of two labels, the trained points only."""
    e = scaled_vectors(spark, sf_dir)
    labels = e.where("class in (1, 2)").select("idx", F.col("class").cast("string").alias("label"))
    shown = R.picture(e.select("idx", "vec"), labels, only=True, trained=e.where("idx % 2 = 0"))
    return shown.where("x is not null and y is not null").groupBy("label").agg(F.count("*").alias("n"))
