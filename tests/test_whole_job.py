"""Reference queries over all rows, against brute force."""


def test_reconstruction_of_all_vectors(spark, monkeypatch):
    import numpy as np

    from treelake.operators.metrics import _poincare_block, reconstruction
    from treelake.plans import queries as Q

    rng = np.random.default_rng(6)
    vecs = rng.uniform(-0.3, 0.3, (60, 5))
    vecs[7] = vecs[3]  # a tie
    rows = [(i, vecs[i].tolist(), i % 4) for i in range(60)]
    emb = spark.createDataFrame(rows, "idx int, vec array<double>, class int")
    monkeypatch.setattr(Q, "scaled_vectors", lambda spark, sf_dir: emb)
    monkeypatch.setattr(Q.M, "reconstruction", lambda near, e: reconstruction(near, e, tile=16))
    got = {r.source: (r.n, r.mean_rank, r.ap) for r in Q.QUERIES["reconstruction_map"](spark, "").collect()}
    d, want = _poincare_block(vecs, vecs, True), {}
    for i in range(60):
        hits = [j % 4 == i % 4 for _, j in sorted((d[i, j], j) for j in range(60) if j != i)]
        places = [p for p, h in enumerate(hits, 1) if h]
        want[i] = (len(places), sum(p - k for k, p in enumerate(places)) / len(places), sum((k + 1) / p for k, p in enumerate(places)) / len(places))
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-5 and abs(got[i][2] - w[2]) < 1e-5
