"""Hand-made trees and edge cases, sources and sinks, building and training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelake.functions import names as N
from treelake.functions import vectors as V
from treelake.operators import metrics as M
from treelake.operators import noise as X
from treelake.operators import pairs as P
from treelake.operators import sampling as S
from treelake.operators import training
from treelake.operators import tree as T
from treelake.operators import validate as C
from treelake.plans.build import build_dataset
from treelake.sources import readers, writers


def nodes_of(spark, rows):
    return spark.createDataFrame([(*r, *(None, None)[len(r) - 2 :]) if len(r) < 4 else r for r in rows], "taxid long, parent long, rank string, name string")


def binary(spark, depth=3):
    return nodes_of(spark, [(100, 100)] + [(100 + i, 100 + (i - 1) // 2) for i in range(1, 2 ** (depth + 1) - 1)])


def test_binary_tree(spark):
    nodes = binary(spark)
    paths = T.node_paths(T.edges_of(nodes), 100)
    diffs = {r.depth_diff: r["count"] for r in T.closure(paths).groupBy("depth_diff").count().collect()}
    assert diffs == {1: 14, 2: 12, 3: 8}
    gp = {r.taxid: r.grandparent for r in T.grandparents(paths).collect()}
    assert gp[107] == gp[109] == 101 and gp[111] == 102
    cls = {r.taxid: r["class"] for r in T.class_labels(paths).collect()}
    assert cls[107] == 101 and cls[114] == 102 and 100 not in cls


def test_paths_of_odd_trees(spark):
    rows = [(1, 1), (2, 1), (3, 2), (50, 51), (51, 50), (60, 61), (3, 2)]
    edges = T.edges_of(nodes_of(spark, rows))
    got = {r.taxid: list(r.path) for r in T.node_paths(edges, 1).collect()}
    assert got == {1: [1], 2: [1, 2], 3: [1, 2, 3]}  # the root's self-loop, a cycle and an unreachable node
    assert {r.taxid for r in T.node_paths(edges, 2).collect()} == {2, 3}
    assert [r.taxid for r in T.node_paths(edges, 3).collect()] == [3]
    assert [r.taxid for r in T.node_paths(edges, 1, max_depth=0).collect()] == [1]
    assert {r.taxid for r in T.node_paths(edges, 1, max_depth=1).collect()} == {1, 2}
    chain = T.edges_of(nodes_of(spark, [(i, i - 1) for i in range(1, 40)]))
    deep = {r.taxid: r.depth for r in T.node_paths(chain, 0).collect()}
    assert deep == {i: i for i in range(40)}
    assert {r.taxid: r.depth for r in T.node_paths(chain, 0, max_depth=9).collect()} == {i: i for i in range(10)}


def loop_prune(parent, removable, root):
    """The rule applied again and again until nothing changes."""
    live = set(parent) | {root}
    while True:
        inner = {p for c, p in parent.items() if c in live}
        gone = {n for n in live if n != root and n in removable and n not in inner}
        if not gone:
            return live
        live -= gone


def test_pruning_is_the_fix_point(spark):
    rng = np.random.default_rng(2)
    parent = {i: int(rng.integers(0, i)) for i in range(1, 120)}
    names = {i: rng.choice(["x sp. 1", "unclassified y", "fine", None], p=[0.4, 0.3, 0.2, 0.1]) for i in range(120)}
    nodes = nodes_of(spark, [(0, 0, "r", names[0])] + [(c, p, "r", names[c]) for c, p in parent.items()])
    paths = T.node_paths(T.edges_of(nodes), 0)
    want = loop_prune(parent, {i for i, n in names.items() if n != "fine"}, 0)
    assert {r.taxid for r in X.prune(paths, nodes, 0).collect()} == want
    audited = X.audit(paths, nodes).collect()
    assert len(audited) == 120 and all(r.removal_reason for r in audited if r.is_removed)


def test_reparenting_with_several_roots(spark):
    paths = T.node_paths(T.edges_of(binary(spark)), 100)
    keep = spark.createDataFrame([(i,) for i in (101, 107, 108, 111, 112, 102)], "taxid long")
    got = {r.taxid: (r.parent, r.depth) for r in X.reparent(paths, keep).collect()}
    assert got == {101: (None, 0), 102: (None, 0), 107: (101, 1), 108: (101, 1), 111: (102, 1), 112: (102, 1)}


def test_names(spark):
    df = spark.createDataFrame([("Genus SP. 4",), ("cf. x Hybrid",), ("environmental samples",), (None,), ("--",), ("A b/C",)], "name string")
    got = [tuple(r) for r in df.select(F.array_join(N.noise_categories(F.col("name")), "|"), N.container_category(F.col("name")), N.slugify(F.col("name"))).collect()]
    assert got == [("sp.", None, "genus_sp_4"), ("nr./cf./aff.|hybrid", None, "cf_x_hybrid"), ("environmental", "environmental samples", "environmental_samples"), ("", None, "clade"), ("", None, "clade"), ("", None, "a_b_c")]
    assert N.curriculum_phases("20:3,1:1,50:None") == [(1, 1), (20, 3), (50, None)]
    auto = N.automatic_phases(20, 100)
    assert len(auto) == 4 and auto[0][1] == 1 and auto[-1][1] is None and [e for e, _ in auto] == sorted({e for e, _ in auto})


def test_vector_edges(spark):
    rows = [([0.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [0.6, 0.8]), ([0.3, 0.1], [0.3, 0.1])]
    df = spark.createDataFrame(rows, "u array<double>, v array<double>")
    d = [r.d for r in df.select(V.poincare_distance(F.col("u"), F.col("v")).alias("d")).collect()]
    assert d[0] == pytest.approx(np.arccosh(1 + 1e-5)) and d[2] == pytest.approx(d[0], rel=1e-3) and d[1] > 10
    r = spark.range(1).select(V.target_radius(F.lit(0.0), F.lit(0.0)).alias("a"), V.target_radius(F.lit(10.0), F.lit(10.0), "log").alias("b")).first()
    assert (r.a, r.b) == (0.1, pytest.approx(0.95))
    x = df.limit(1).select(V.norm(V.tanh_map(F.col("u"))).alias("zero")).first()
    assert x.zero == 0
    p = df.where("u[0] = 0.3").select(V.lorentz_to_poincare(V.poincare_to_lorentz(F.col("u"))).alias("p"), V.lorentz_distance(V.poincare_to_lorentz(F.col("u")), V.poincare_to_lorentz(F.array(F.lit(0.5), F.lit(0.0)))).alias("l"), V.poincare_distance(F.col("u"), F.array(F.lit(0.5), F.lit(0.0)), "exact").alias("e")).first()
    assert list(p.p) == pytest.approx([0.3, 0.1]) and p.l == pytest.approx(p.e)


def test_knn_of_separated_classes_and_duplicates(spark):
    rows = [(1, [0.5, 0, 0], 1), (3, [0.6, 0.1, 0], 1), (4, [0.6, -0.1, 0], 1), (2, [-0.5, 0, 0], 2), (5, [-0.6, 0.1, 0], 2), (6, [-0.6, -0.1, 0], 2), (7, [-0.6, -0.1, 0], 2)]
    emb = spark.createDataFrame([(i, [float(x) for x in v], c) for i, v, c in rows], "idx int, vec array<double>, class int")
    assert M.knn_purity(emb, "class", 2).first().purity == 1
    assert M.class_separation(emb, "class").first().ratio > 1
    near = {(r.idx, r["rank"]): r.neighbor for r in M.nearest_neighbors(emb, 50).collect()}
    assert near[6, 1] == 7 and near[7, 1] == 6 and len(near) == 42
    assert M.class_separation(emb.where("class = 1"), "class").first().ratio == 0
    assert M.knn_purity(emb.limit(0), "class").first().purity == 0
    assert M.packing_dimension(1) == 1 and M.packing_dimension(1000, 0.2) > M.packing_dimension(1000, 0.3)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(20)], "idx int, vec array<double>")
    assert M.participation_ratio(line).first().participation_ratio == pytest.approx(1)
    flat = spark.createDataFrame([(1, 0.5), (2, 0.5)], "depth int, norm double")
    assert M.depth_norm_correlation(flat).first().pearson == 0


def test_samplers(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("dd"))
    counts = lambda d: {r.dd: r["count"] for r in d.groupBy("dd").count().collect()}
    assert counts(S.fraction_sample(df, "dd", 0.3, 1, ["id"])) == {0: 30, 1: 30, 2: 30}
    assert counts(S.fraction_sample(df.where("id < 3"), "dd", 0.01, 1, ["id"])) == {0: 1, 1: 1, 2: 1}
    assert S.stratified_subsample(df, "dd", 100, 1, ["id"]).count() == 100
    assert S.stratified_subsample(df, "dd", 1000, 1, ["id"]).count() == 300
    assert sorted(S.stratified_subsample(df, "dd", 50, 1, ["id"]).collect()) == sorted(S.stratified_subsample(df.repartition(7), "dd", 50, 1, ["id"]).collect())
    assert counts(S.class_balanced(df.where("dd < 2 or id < 9"), "dd", 150, 1, ["id"])) == {0: 50, 1: 50, 2: 50}
    w = spark.createDataFrame([(1, 1.0), (2, 0.0), (3, 9.0)], "id long, weight double")
    drawn = {r.id: r["count"] for r in S.weighted_draws(w, 1000, 3).groupBy("id").count().collect()}
    assert set(drawn) == {1, 3} and 850 < drawn[3] < 950 and sum(drawn.values()) == 1000


def test_negatives_fill_every_row_and_skip_self(spark):
    nodes = binary(spark)
    paths = T.node_paths(T.edges_of(nodes), 100)
    table = training.node_table(paths, P.dense_mapping(nodes))
    neg = S.negatives(table, 4, 1, [("grandparent", ["gp", "depth"], 2), ("depth", ["depth"], 4)])
    rows = neg.collect()
    assert len(rows) == 60 and all(r.descendant_idx != r.negative_idx and 0 <= r.negative_idx < 15 for r in rows)
    gp = {r.idx: r.gp for r in table.collect()}
    assert all(gp[r.descendant_idx] == gp[r.negative_idx] for r in rows if r.tier == "grandparent")
    assert S.negatives(table.limit(1), 2, 1, [("depth", ["depth"], 2)]).count() == 0
    bar = table.select("idx", F.lit(3).alias("negative_idx"))
    assert S.negatives(table, 4, 1, [("depth", ["depth"], 4)], bar).where("negative_idx = 3").count() == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\t\t|\n2\t|\t1\t|\tphylum\t|\tx\t|\nbad\t|\tline\t|\n")
    (tmp_path / "names.dmp").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tAaa\t|\t\t|\tsynonym\t|\n2\t|\tMol \"l\" usca\t|\tu\t|\tscientific name\t|\n3\t|\tonly\t|\t\t|\tsynonym\t|\n")
    assert [tuple(r) for r in readers.nodes_dump(spark, f"{tmp_path}/nodes.dmp").collect()] == [(1, 1, "no rank"), (2, 1, "phylum")]
    names = readers.preferred_names(readers.names_dump(spark, f"{tmp_path}/names.dmp"))
    assert dict(names.collect()) == {1: "root", 2: 'Mol "l" usca', 3: "only"}
    edges = spark.createDataFrame([(1, 2), (2, 3)], "parent long, child long")
    writers.edge_list(edges, f"{tmp_path}/e")
    assert sorted(map(tuple, readers.edge_list(spark, f"{tmp_path}/e").collect())) == [(1, 2), (2, 3)]
    writers.edges_csv(edges, f"{tmp_path}/c")
    assert sorted(map(tuple, readers.edges_csv(spark, f"{tmp_path}/c").collect())) == [(1, 2), (2, 3)]
    (tmp_path / "m.tsv").write_text("taxid\tidx\n5\t0\nx\t1\n6\t2\n")
    assert sorted(map(tuple, readers.mapping_tsv(spark, f"{tmp_path}/m.tsv").collect())) == [(5, 0), (6, 2)]
    with pytest.raises(Exception):
        readers.mapping_tsv(spark, f"{tmp_path}/m.tsv", strict=True).collect()
    (tmp_path / "co.csv").write_text("id1,id2,weight\na,b,2\na,b,3\n")
    assert [tuple(r) for r in readers.csr(readers.cooccurrence(spark, f"{tmp_path}/co.csv", True)).orderBy("id1").collect()] == [("a", [("b", 5.0)]), ("b", [("a", 5.0)])]
    lines = spark.createDataFrame([(1, "1 2"), (2, "1"), (3, "a b"), (4, " 3\t4 ")], "line_no int, value string")
    assert {r.line_no for r in C.validate_edgelist(lines).collect()} == {2, 3}
    bad = spark.createDataFrame([("1", 0), ("1", 2), ("x", 2)], "taxid string, idx int")
    assert tuple(C.validate_mapping(bad).first()) == (3, 1, 1, 1, False)


def test_build_and_read_a_dataset(spark, tmp_path):
    nodes = nodes_of(spark, [(1, 1, "r", "Top"), (2, 1, "r", "a"), (3, 2, "r", "b sp. 1"), (4, 2, "r", "c"), (5, 1, "r", "unclassified z"), (6, 5, "r", "uncultured q")])
    data = build_dataset(nodes, 1, "top_1", str(tmp_path), clean=True)
    assert (data.node_count, data.edge_count, data.pairs_count, data.max_depth) == (3, 2, 3, 2)
    back = readers.pairs_parquet(spark, data.files["pairs"], deepest=1)
    assert back.count() == 2
    one = readers.json_record(spark, data.files["manifest"], "dataset_name string, nodes long, clean boolean").first()
    assert tuple(one) == ("top_1", 3, True)
    assert build_dataset(nodes, 4, "leaf").pairs_count == 1  # a single node is paired with itself
    small = build_dataset(nodes, 1, "few", max_pairs=6)
    assert small.pairs_count == 6
    with pytest.raises(ValueError):
        build_dataset(nodes, 1, "none", max_pairs=2)


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    a, d, n = rng.normal(0, 0.2, (3, 4)), rng.normal(0, 0.2, (3, 4)), rng.normal(0, 0.2, (3, 5, 4))
    m, w = np.full(3, 0.5), np.array([1.0, 2.0, 0.5])
    f = lambda a, d, n: training.loss_and_gradient(a, d, n, m, w)[0].sum()
    _, ga, gd, gn = training.loss_and_gradient(a, d, n, m, w)
    for x, g, at in ((a, ga, (1, 2)), (d, gd, (0, 3)), (n, gn, (2, 1, 0))):
        old, h = x[at], 1e-6
        x[at] = old + h
        up = f(a, d, n)
        x[at] = old - h
        down = f(a, d, n)
        x[at] = old
        assert (up - down) / (2 * h) == pytest.approx(g[at], abs=1e-5)


def test_training_lowers_the_loss(spark, tmp_path):
    nodes = binary(spark)
    data = build_dataset(nodes, 100, "bin")
    table = training.node_table(data.paths, data.mapping)
    vectors, history = training.train(data.pairs, table, training.Options(dim=6, epochs=5, negatives=4, rate=0.03, batches=4, curriculum=False), str(tmp_path))
    h = history.orderBy("epoch").collect()
    assert h[-1].loss < h[0].loss and h[-1].depth_norm_corr > 0.5
    assert M.norms(vectors).agg(F.max("norm")).first()[0] < 1 and vectors.count() == 15
    assert writers.leaderboard(spark, str(tmp_path)).first().loss == min(x.loss for x in h)
    least = min(h, key=lambda x: x.loss)  # the best epoch's vectors are kept and returned
    assert [x.epoch for x in h if x.best][-1] == least.epoch
    kept = readers.vectors_parquet(spark, f"{tmp_path}/best/vectors")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, vectors.select(F.col("idx").cast("int"), "vec").collect()))
    more = training.Options(dim=6, epochs=7, negatives=4, rate=0.03, batches=4, curriculum=False)
    _, later = training.train(data.pairs, table, more, str(tmp_path), resume=True)
    assert sorted(r.epoch for r in later.collect()) == [6, 7]
    assert writers.last_checkpoint(spark, str(tmp_path))[1] == 7


def test_curriculum_keeps_the_best_quality(spark, tmp_path):
    data = build_dataset(binary(spark), 100, "bin")
    table = training.node_table(data.paths, data.mapping)
    o = training.Options(dim=4, epochs=3, negatives=2, batches=1, phases=N.curriculum_phases("2:1,3:None"), burn_in=1, class_balanced=True, scaled_margin=True, max_pairs=40)
    h = training.train(data.pairs, table, o, str(tmp_path))[1].orderBy("epoch").collect()
    assert not h[0].best and h[1].best  # burn-in is never best
    assert max(h[1:], key=lambda x: x.quality).epoch == [x.epoch for x in h if x.best][-1]
    assert training.train(data.pairs, table, o, str(tmp_path), resume=True)[1].count() == 0


def test_phases():
    assert N.curriculum_phases(" 20:3, 1:1,50:None") == [(1, 1), (20, 3), (50, None)]
    for bad in ("", "1", "1:x", "1:1,", "1:1;2:2", "-1:2"):
        with pytest.raises(ValueError):
            N.curriculum_phases(bad)
    phases = [(5, 1), (9, None)]
    assert [training.phase_limit(phases, e) for e in (1, 5, 8, 9)] == [None, 1, 1, None]


def test_train_command_records_the_run(spark, tmp_path):
    from treelake import cli

    build_dataset(binary(spark, 2), 100, "bin", str(tmp_path))
    data = next(p.parent for p in tmp_path.rglob("pairs"))
    for extra, ended in ((["--curriculum-phases", "1:1,2:None", "--class-weighted-loss", "--optimizer", "riemannian", "--batch-size", "9"], "done"), (["--dim", "-1"], "failed")):
        out = f"{tmp_path}/run{len(extra)}"
        args = cli.parser().parse_args(["train", str(data), "--out", out, "--epochs", "1", "--dim", "3", "--n-negatives", "2", *extra])
        if ended == "failed":
            with pytest.raises(Exception):
                cli.train(spark, args)
        else:
            cli.train(spark, args)
            assert readers.vectors_parquet(spark, f"{out}/vectors").count() == 7
        assert readers.json_record(spark, f"{out}/run.json", "status string").first().status == ended


def test_streaming_counts_equal_batch(spark, tmp_path):
    from treelake.streaming.arrivals import pairs_by_difference

    paths = T.node_paths(T.edges_of(binary(spark)), 100)
    for k in range(2):
        spark.createDataFrame([(200 + 10 * k + i, 107 + i) for i in range(5)], "taxid long, parent long").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("taxid long, parent long").parquet(f"{tmp_path}/in/*")
    q = pairs_by_difference(stream, paths).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = pairs_by_difference(spark.read.parquet(f"{tmp_path}/in/*"), paths)
    assert sorted(map(tuple, spark.table("arrived").collect())) == sorted(map(tuple, batch.collect())) == [(1, 10), (2, 10), (3, 10), (4, 10)]


def test_deep_chain_and_cycles(spark):
    from treelake.operators.tree import node_paths

    n = 6001
    edges = [(i, i + 1) for i in range(1, n)] + [(8001, 8002), (8002, 8001), (8002, 8003), (8003, 8004), (9001, 9002)]
    paths = node_paths(spark.createDataFrame(edges, "parent long, child long"), 1)
    row = paths.selectExpr("count(*) n", "max(depth) deepest", "min(taxid) low", "max(taxid) high").first()
    assert (row.n, row.deepest, row.low, row.high) == (n, n - 1, 1, n)


def test_negatives_with_rejection_fill_up(spark):
    from treelake.operators.sampling import rejecting_negatives

    nodes = spark.range(40).selectExpr("cast(id as int) idx")
    positives = [(i, j) for i in range(40) for j in range(30) if i % 4 == 0 and j != i]  # these may draw 10 nodes at most
    got = rejecting_negatives(nodes, spark.createDataFrame(positives, "idx int, negative_idx int"), 5, 3).collect()
    bad, by = set(positives), {}
    for r in got:
        assert r.negative_idx != r.descendant_idx and (r.descendant_idx, r.negative_idx) not in bad
        by.setdefault(r.descendant_idx, []).append((r.draw_no, r.negative_idx))
    assert len(by) == 40 and all(sorted(d for d, _ in v) == [1, 2, 3, 4, 5] and len({x for _, x in v}) == 5 for v in by.values())


def test_subsample_of_hot_and_tiny_strata(spark):
    """Against ranks over all rows: one stratum holds most rows, many hold one, some rows are repeated, one has no stratum."""
    import hashlib

    from treelake.operators.sampling import stratified_subsample

    rows = [(i, 0) for i in range(3000)] + [(5000 + i, 1 + i) for i in range(30)] + [(9000 + i, 50) for i in range(200)] + [(17, 0)] * 2 + [(1, None)]
    df = spark.createDataFrame(rows, "id int, stratum int").repartition(3)
    held = [r for r in rows if r[1] is not None]
    mark = lambda r: (hashlib.md5(f"7|{r[0]}".encode()).hexdigest(), r[0])
    for most in (10, 400, 5000):
        late = []
        for g in {r[1] for r in held}:
            own = sorted((r for r in held if r[1] == g), key=mark)
            quota = max(1, int(most * len(own) / len(held) + 1e-9))
            late += [(i >= quota, *mark(r), r[1]) for i, r in enumerate(own)]
        want = sorted((x[2], x[3]) for x in sorted(late)[:most])
        assert sorted(map(tuple, stratified_subsample(df, "stratum", most, 7, ["id"]).collect())) == want
