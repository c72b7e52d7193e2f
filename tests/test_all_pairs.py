"""All pairs of vectors without a row a pair, against brute force."""

import numpy as np


def _vectors(spark, n, kinds=4, seed=6):
    rng = np.random.default_rng(seed)
    v = rng.uniform(-0.3, 0.3, (n, 5))
    v[7] = v[3]  # a copy in the same class, and one in another
    v[8] = v[3]
    rows = [(i, v[i].tolist(), i % kinds if i else None) for i in range(n)]
    return v, spark.createDataFrame(rows, "idx int, vec array<double>, class int")


def test_places_among_classes_match_brute_force(spark):
    from treelake.operators.metrics import _poincare_block, reconstruction_of_classes

    v, emb = _vectors(spark, 60)
    cls = [None] + [i % 4 for i in range(1, 60)]
    d, want = _poincare_block(v, v, True), {}
    for i in range(1, 60):
        hits = [cls[j] == cls[i] for _, j in sorted((d[i, j], j) for j in range(60) if j != i)]
        places = [p for p, h in enumerate(hits, 1) if h]
        want[i] = (len(places), sum(p - k for k, p in enumerate(places)) / len(places), sum((k + 1) / p for k, p in enumerate(places)) / len(places))
    for tile in (7, 64):
        got = {r.source: (r.n, r.mean_rank, r.ap) for r in reconstruction_of_classes(emb, "class", tile).collect()}
        assert set(got) == set(want)
        assert all(got[i][0] == w[0] and np.allclose(got[i][1:], w[1:]) for i, w in want.items())


def test_links_of_classes_are_no_rows(spark, monkeypatch):
    """Before, reconstruction_map joined the vectors with themselves."""
    from treelake.operators import rings
    from treelake.plans import queries as Q

    monkeypatch.setattr(Q, "scaled_vectors", lambda spark, sf_dir: _vectors(spark, 60)[1])
    monkeypatch.setattr(rings, "link_places", None)
    assert Q.QUERIES["reconstruction_map"](spark, "").count() == 59


def test_sums_of_distances_match_brute_force_with_a_task_a_block(spark):
    from treelake.operators.metrics import _poincare_block, distance_sums

    v, emb = _vectors(spark, 61)
    d, cls = _poincare_block(v, v, True), np.array([-1] + [i % 4 for i in range(1, 61)])
    for tile in (9, 10, 64):  # odd and even circles of blocks, and one block
        for bins, width in ((64, 0.25), (1, 1.0)):
            out = distance_sums(emb, "class", tile, width, bins)
            want = {}
            for i in range(1, 61):
                for j in range(1, 61):
                    if i != j:
                        at = want.setdefault((bool(cls[i] == cls[j]), min(int(d[i, j] / width), bins - 1)), [0, 0.0, 0.0])
                        at[0], at[1], at[2] = at[0] + 1, at[1] + d[i, j], at[2] + d[i, j] ** 2
            got = {(r.same, r.bin): (r.n, r.total, r.squares) for r in out.collect()}
            assert set(got) == set(want)
            assert all(got[k][0] == w[0] and np.allclose(got[k][1:], w[1:]) for k, w in want.items())


def test_hierarchy_of_groups_matches_its_pairs(spark):
    from treelake.operators.metrics import hierarchy_share_of_groups

    rng = np.random.default_rng(3)
    rows = [(int(g), float(x) / 5) for g, x in zip(rng.integers(0, 5, 200), rng.integers(0, 5, 200))]  # many ties
    a = spark.createDataFrame([(g + 1, x) for g, x in rows] + [(None, 0.1)], "c int, norm double")
    b = spark.createDataFrame(rows + [(None, 0.9)], "c int, norm double")
    pairs = [(x, y) for g, x in rows for h, y in rows if h == g + 1]
    got = hierarchy_share_of_groups(a, b, "c").first()
    assert got.n == len(pairs) and abs(got.hierarchy_pct - 100 * sum(x < y for x, y in pairs) / len(pairs)) < 1e-9
    none = hierarchy_share_of_groups(a.where("false"), b, "c").first()
    assert none.n == 0 and none.hierarchy_pct is None
