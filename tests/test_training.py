"""Manifolds, block gradients, optimisers and the loop, against differences, brute force and each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from treelake.functions.manifolds import LOSSES, MANIFOLDS, cone_energy
from treelake.operators import blocks as B
from treelake.operators import pairs as P
from treelake.operators import training as L
from treelake.operators import tree as T
from treelake.tables import saved

from .test_hierarchy import binary


def differences(f, x, h=1e-6):
    g = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        old = x[i]
        x[i] = old + h
        up = f()
        x[i] = old - h
        down = f()
        x[i] = old
        g[i] = (up - down) / (2 * h)
    return g


def points(space, n, seed):
    return np.array(space.of_ball(np.random.default_rng(seed).normal(size=(n, 3)) * 0.25 + 0.1))


@pytest.mark.parametrize("name", MANIFOLDS)
def test_gradients_equal_differences(name):
    space = MANIFOLDS[name]()
    u, v = points(space, 6, 1), points(space, 6, 2)
    for f in (space.distance, space.angle, lambda a, b: cone_energy(space, a, b)):
        _, gu, gv = f(u, v)
        assert np.allclose(differences(lambda: f(u, v)[0].sum(), u), gu, atol=1e-5) and np.allclose(differences(lambda: f(u, v)[0].sum(), v), gv, atol=1e-5)
    assert np.allclose(differences(lambda: space.aperture(u)[0].sum(), u), space.aperture(u)[1], atol=1e-5)
    a, d, n = points(space, 4, 3), points(space, 4, 4), points(space, 12, 5).reshape(4, 3, -1)
    m, w = np.full(4, 0.5), np.array([1.0, 2.0, 0.5, 3.0])
    for loss in LOSSES.values():
        by = loss(space, a, d, n, m, w)[1:]
        for x, g in zip((a, d, n), by):
            assert np.allclose(differences(lambda: loss(space, a, d, n, m, w)[0].sum(), x), g, atol=1e-5)


def test_maps_of_manifolds():
    ball = np.random.default_rng(0).normal(size=(50, 4)) * 0.2
    for name, space in ((n, m()) for n, m in MANIFOLDS.items()):
        x = space.of_ball(ball)
        assert x.shape[1] == space.width(4) and np.allclose(space.to_ball(x), ball)
    lorentz, poincare = MANIFOLDS["lorentz"](), MANIFOLDS["poincare"]()
    x = lorentz.of_ball(ball)
    assert np.allclose(lorentz.dot(x, x), -1)
    assert np.allclose(lorentz.distance(x[:25], x[25:])[0], poincare.distance(ball[:25], ball[25:])[0], atol=1e-3)
    assert np.allclose(lorentz.aperture(x)[0], poincare.aperture(ball)[0], atol=1e-3)
    assert np.allclose(lorentz.angle(x[:25], x[25:])[0], poincare.angle(ball[:25], ball[25:])[0], atol=1e-3)
    step = lorentz.riemannian(x, np.ones_like(x))
    assert np.allclose(lorentz.dot(x, step), 0, atol=1e-9)  # tangent
    moved = lorentz.move(x, -step)
    assert np.allclose(lorentz.dot(moved, moved), -1)
    n = np.sqrt(lorentz.dot(step, step))
    assert np.allclose(np.arccosh(-lorentz.dot(x, moved)), np.minimum(n, 1), atol=1e-6)  # as far as the step is long, 1 at most
    inner = lorentz.outside(lorentz.of_ball(ball * 1e-3))
    assert np.allclose(np.linalg.norm(lorentz.to_ball(inner), axis=1), lorentz.inner_radius + 1e-5)


def test_tanh_points_never_leave_the_ball():
    space = MANIFOLDS["tanh"]()
    z = np.random.default_rng(1).normal(size=(100, 5))
    for _ in range(3):
        z = space.move(z, 10 * z)
    assert np.isfinite(z).all() and (np.linalg.norm(space.to_ball(z), axis=1) < 1 + 1e-12).all()
    small = np.zeros((2, 5))
    assert np.allclose(space._back(small, np.ones((2, 5))), 0.5)  # half the gradient at the origin
    assert np.allclose(space.to_ball(np.array([[2.0, 0, 0, 0, 0]]))[0, 0], np.tanh(1))


def whole(spark, n, links, size, loss="ranking", manifold="poincare", **more):
    """Vectors, and the gradients that blocks of `size` rows give, as a matrix."""
    space = MANIFOLDS[manifold]()
    x = points(space, n, 9)
    rows = [(i, 0.5, [7 if i % 2 else 8], v.tolist()) for i, v in enumerate(x)]
    packed = B.pack(spark.createDataFrame(rows, "idx int, target double, pools array<long>, x array<double>"), size, {"target": "<f8", "pools": "<i8", "x": "<f8"})
    state = saved(L._moved(packed, lambda y, _: y), "state")
    grads = saved(B.block_gradients(links, state, manifold, loss, size=size, n_blocks=-(-n // size), **more), "grads")
    out = np.zeros_like(x)
    for r in B.gradient_rows(grads.where(F.octet_length("place") > 0), x.shape[1]).collect():
        out[r.block * size + r.place] = r.g
    one = grads.agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    return x, state, grads, out, one


@pytest.mark.parametrize("loss, manifold", [("ranking", "poincare"), ("softmax", "lorentz"), ("cones", "euclidean"), ("ranking", "tanh")])
def test_block_gradients_equal_whole_ones(spark, monkeypatch, loss, manifold):
    """Links across many blocks, repeated links, and one pair of blocks with most links in several shares."""
    rng = np.random.default_rng(4)
    n = 40
    links = [(int(a), int(b), rng.choice(n, 3, replace=False).tolist(), 0.3, float(w)) for a, b, w in zip(rng.integers(0, n, 150), rng.integers(0, n, 150), rng.random(150)) if a != b]
    links += [(1, 2, [30, 31, 32], 0.5, 0.2)] * 2 + [(1, int(b), [5, 6, 7], 0.5, 0.1) for b in rng.integers(2, 6, 200)]
    df = spark.createDataFrame(links, "ancestor_idx int, descendant_idx int, negatives array<int>, margin double, weight double").repartition(4)
    monkeypatch.setattr(B, "GROUP_LINKS", 50)
    x, _, _, got, one = whole(spark, n, df, 6, loss, manifold)
    a, d, neg, m, w = (np.array(c) for c in zip(*links))
    losses, ga, gd, gn = LOSSES[loss](MANIFOLDS[manifold](), x[a], x[d], x[neg], m, w)
    want = np.zeros_like(x)
    np.add.at(want, a, ga)
    np.add.at(want, d, gd)
    np.add.at(want, neg, gn)
    assert np.allclose(got, want, atol=1e-9) and one.n == len(links) and one.loss == pytest.approx(losses.sum())


def test_drawn_negatives_share_the_pool():
    rows = {"block": 0, "idx": np.arange(10).astype("<i8").tobytes(), "x": np.zeros((10, 2)).tobytes()}
    pools = np.array([[1, 5]] * 4 + [[2, 5]] * 5 + [[3, 0]])
    at = B.AtHand([{**rows, "pools": pools.astype("<i8").tobytes()}], 2)
    desc = np.repeat(np.arange(10), 200)
    got = at.draw(np.random.default_rng(1), desc, 6, [4, 6])
    assert (got >= 0).all() and (got != desc[:, None]).all()
    kin = pools[:, 0][got[:, :4]] == pools[:, 0][desc][:, None]
    assert kin[desc < 9].all() and (pools[:, 1][got[:, 4:]] == 5)[desc < 9].all()
    assert set(got[desc == 9].ravel()) == set(range(9))  # alone in its pool, and in none of the second tier
    for i in range(4):  # each other row of the pool about as often
        counts = np.bincount(got[desc == i, :4].ravel(), minlength=4)
        assert counts[i] == 0 and min(np.delete(counts, i)) > 200


def test_descent_writes_touched_blocks_only(spark):
    links = spark.createDataFrame([(0, 1, [2, 3], 0.5, 1.0), (0, 3, [1, 13], 0.5, 1.0)], "ancestor_idx int, descendant_idx int, negatives array<int>, margin double, weight double")
    x, state, grads, g, _ = whole(spark, 40, links, 4)
    versions = B.Versions(state, most=3)
    rate, space, want = 0.2, MANIFOLDS["poincare"](), x.copy()
    touched = np.abs(g).sum(1) > 0
    for _ in range(5):
        B.descend(versions, grads, rate)
        want[touched] = space.move(want[touched], -rate * space.riemannian(want[touched], g[touched]))
    assert versions.written == [2] * 5 and len(versions.tables) <= 3  # of ten blocks
    got = {r.idx: r.vec for r in L.ball_vectors(versions.current()).collect()}
    assert len(got) == 40 and np.allclose([got[i] for i in range(40)], want, atol=1e-12)


def nodes_and_pairs(spark, depth=3):
    nodes = binary(spark, depth)
    paths = T.node_paths(T.edges_of(nodes), 100)
    mapping = P.dense_mapping(nodes)
    return saved(P.pair_table(paths, mapping), "pairs"), saved(L.node_table(paths, mapping), "nodes")


@pytest.mark.parametrize("kind", [
    {"manifold": "lorentz", "optimizer": "rsgd", "loss": "softmax", "rate": 0.5}, {"manifold": "euclidean", "optimizer": "rsgd", "rate": 0.05, "loss": "softmax"}, {"manifold": "tanh", "rate": 0.05, "tiered": True},
    {"manifold": "poincare", "optimizer": "rsgd", "loss": "cones", "rate": 0.05}, {"riemannian": True, "rate": 0.05, "accumulate": 2, "nudge": 0.05},
])
def test_every_kind_of_training_lowers_its_loss(spark, tmp_path, kind):
    table, nodes = nodes_and_pairs(spark)
    options = L.Options(dim=4, epochs=3, negatives=4, batches=2, curriculum=False, patience=0, radial=0.0, **kind)
    vectors, history = L.train(table, nodes, options, str(tmp_path))
    h = history.orderBy("epoch").collect()
    assert min(x.loss for x in h[1:]) < h[0].loss
    v = np.array([r.vec for r in vectors.collect()])
    assert v.shape == (15, 4) and np.isfinite(v).all() and (kind.get("manifold") == "euclidean" or (np.linalg.norm(v, axis=1) < 1).all())
    if kind.get("manifold") == "lorentz":
        assert L.train(table, nodes, options, str(tmp_path), resume=True)[1].count() == 0


def test_training_of_one_node_and_of_none(spark):
    table, nodes = nodes_and_pairs(spark, 1)
    vectors, history = L.train(table.limit(0), nodes.where("idx = 0"), L.Options(dim=3, epochs=1, curriculum=False))
    assert vectors.count() == 1 and history.first().loss == 0
