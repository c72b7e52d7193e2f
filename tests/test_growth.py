"""Figures that must not grow with the largest group: numbering and hot keys."""

from pyspark.sql import functions as F


def test_rows_are_numbered_with_one_shuffle(spark, monkeypatch):
    from treelake import tables

    plans, save = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df, name: plans.append(df) or save(df, name))
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    out = tables.dense_index(rows, ["k"], "i", "long")
    assert out.where("i <> k").count() == 0 and out.count() == 1000
    total = tables.running_total(rows, ["k"], F.col("k"), "t")
    assert total.where("t <> k * (k + 1) / 2").count() == 0 and total.count() == 1000
    assert "Window" not in "".join(p._jdf.queryExecution().executedPlan().toString() for p in plans)
    after = out.where("k >= 0")._jdf.queryExecution().executedPlan().toString()
    assert "_part" not in "".join(line for line in after.splitlines() if "Window" in line and "_n" not in line)


def test_hot_groups_meet_their_rows_by_broadcast(spark):
    from treelake import tables

    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 50), (None, 51)], "g int, i int")
    groups = spark.createDataFrame([(1, 50, "a"), (2, 1, "b"), (3, 1, "c")], "g int, n int, x string")
    for most in (1, 0, 10, 100):
        got = {(r.i, r.x) for r in tables.with_group(rows, groups, ["g"], "n", "left", most).collect()}
        assert got == {(i, "a") for i in range(50)} | {(50, "b"), (51, None)}
        assert tables.with_group(rows, groups, ["g"], "n", most=most).count() == 51


def test_pairs_of_hot_ancestors_match_the_join(spark):
    from treelake.operators import pairs as P
    from treelake.operators import tree as T

    edges = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(2, i) for i in range(30, 60)] + [(30, 60)], "parent long, child long")
    paths = T.node_paths(edges, 1)
    mapping = P.dense_mapping(paths.where("taxid <> 3"))
    want = sorted(map(tuple, P.pair_table(paths, mapping).collect()))
    assert len(want) == 58 + 31 + 1 - 0
    for most in (0, 30, 40):
        assert sorted(map(tuple, P.pair_table(paths, mapping, most).collect())) == want
    unmapped = P.dense_mapping(paths.where("taxid <> 1"))  # a hot ancestor without an index
    assert P.pair_table(paths, unmapped, 0).count() == P.pair_table(paths, unmapped).count() == 32


def test_depths_of_indices_add_up_without_sorting(spark):
    from treelake.operators import pairs as P

    pairs = spark.createDataFrame([(0, 1, 1, 0, 1, 5, 6), (1, 2, 1, 9, 2, 6, 7)], P.PAIRS)
    out = P.depth_of_indices(pairs)
    assert {tuple(r) for r in out.collect()} == {(0, 0), (1, 1), (2, 2)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_hot_parents_meet_their_chains_by_broadcast(spark, monkeypatch):
    from treelake import tables
    from treelake.operators import tree as T

    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 5)] + [(4, i) for i in range(10, 40)] + [(5, i) for i in range(40, 43)], "parent long, child long")
    want = sorted(map(tuple, T.node_paths(edges, 1).collect()))
    assert len(want) == 38 and max(r[2] for r in want) == 3
    hot, save = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df, name: hot.append(save(df, name)) or hot[-1])
    for most in (0, 10, 1000):
        hot.clear()
        assert sorted(map(tuple, T.node_paths(edges, 1, most=most).collect())) == want
        tops = {r.top for h in hot for r in h.collect()}
        assert tops == {0: {2, 3, 4, 5}, 10: {4, 2}, 1000: set()}[most]
    monkeypatch.setattr(tables, "saved", save)
    rows, other = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 9), (3, 10), (None, 11)], "k int, i int"), spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "k int, x string")
    for most in (0, 5, 9):
        assert sorted((r.i, r.x) for r in tables.met(rows, other, "k", most).collect()) == [(i, "a") for i in range(9)] + [(9, "b")]


def test_kept_ancestors_of_a_hot_root_match_plain_walks(spark, monkeypatch):
    from treelake import tables
    from treelake.operators import noise as X
    from treelake.operators import tree as T

    up = {i: 1 for i in range(2, 12)} | {i: 2 + i % 10 for i in range(12, 60)} | {60: 59}
    paths = T.node_paths(spark.createDataFrame([(p, c) for c, p in up.items()], "parent long, child long"), 1)
    hot, save = [], tables.saved
    monkeypatch.setattr(tables, "saved", lambda df, name: save(df, name) if name != "hot" else hot.append(save(df, name)) or hot[-1])
    for keep in ({1} | {i for i in up if i % 3}, {i for i in up if i % 3}):
        want = {}
        for i in keep:
            above, at = [], i
            while at in up:
                at = up[at]
                above += [at] if at in keep else []
            want[i] = (above[0] if above else None, len(above))
        ids = spark.createDataFrame([(i,) for i in keep] + [(59,), (59,), (999,)], "taxid long")
        for most in (0, 20, 1000):
            hot.clear()
            assert {r.taxid: (r.parent, r.depth) for r in X.reparent(paths, ids, most).collect()} == want
            assert (1 in {r.a for h in hot for r in h.collect()}) == (most < 1000)


def test_pairs_are_written_a_file_a_task(spark, tmp_path):
    from pathlib import Path

    from treelake.operators import pairs as P
    from treelake.sources import readers, writers

    rows = spark.range(600).select(*[F.col("id").cast("int").alias(c) if c != "depth_diff" else (F.col("id") % 3 + 1).cast("int").alias(c) for c in P.COLUMNS[:5]], *[F.col("id").alias(c) for c in P.COLUMNS[5:]])
    facts = writers.training_data(rows, str(tmp_path), 25)
    assert (facts["n_pairs"], facts["deepest"], facts["bin 1"]) == (600, 3, 200)
    back = readers.pairs_parquet(spark, f"{tmp_path}/pairs")
    assert back.exceptAll(rows.select(*back.columns)).isEmpty() and back.count() == 600
    tasks = [f.name.split("-")[1] for f in Path(tmp_path, "pairs").rglob("part-*.parquet")]
    assert len(tasks) == len(set(tasks)) == 24  # eight files a difference, each by a task that writes no other
    writers.pairs_parquet(rows.where("false"), f"{tmp_path}/none")
