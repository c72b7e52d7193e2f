"""The commands, readers with line numbers, significance and pictures."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from treelake import cli
from treelake.functions.special import correlation_p, incomplete_beta
from treelake.operators import metrics as M
from treelake.operators import projection as R
from treelake.operators import validate as C
from treelake.plans.build import build_dataset
from treelake.sources import readers, writers

from .test_hierarchy import binary


def run(spark, *words):
    args = cli.parser().parse_args(list(map(str, words)))
    args.do(spark, args)


def test_commands_of_a_run(spark, tmp_path, capsys):
    build_dataset(binary(spark), 100, "bin", str(tmp_path))
    data = next(p.parent for p in tmp_path.rglob("pairs"))
    rng = np.random.default_rng(0)
    depth = {r.idx: r.depth for r in spark.read.parquet(f"{data}/pairs").select(F.explode(F.array(F.struct(F.col("ancestor_idx").alias("idx"), F.col("ancestor_depth").alias("depth")), F.struct(F.col("descendant_idx").alias("idx"), F.col("descendant_depth").alias("depth")))).alias("e")).select("e.*").distinct().collect()}
    rows = [(i, (x / np.linalg.norm(x) * (0.1 + 0.25 * d)).tolist()) for i, d in depth.items() for x in [rng.normal(size=3)]]
    spark.createDataFrame(rows, "idx int, vec array<double>").write.parquet(f"{tmp_path}/run/vectors")
    run(spark, "analyze", f"{tmp_path}/run", "--dataset", data, "--out", f"{tmp_path}/report.json", "--min-size", 2)
    report = json.loads(spark.read.text(f"{tmp_path}/report.json").first().value)
    assert report["depth_and_norm"]["verdict"] == "good" and report["depth_and_norm"]["pearson_p"] < 1e-6 and report["boundary"]["inside"]
    assert report["groups"]["1"]["n_intra"] > 0 and report["groups"]["1"]["verdict"] in ("poor", "moderate", "good", "excellent")
    run(spark, "visualize", f"{tmp_path}/run", "--dataset", data, "--out", f"{tmp_path}/xy", "--group", 101, "--group", 100)
    points = spark.read.option("header", True).option("sep", "\t").schema("idx int, label string, x double, y double").csv(f"{tmp_path}/xy").collect()
    assert len(points) == 15 and {p.label for p in points} == {"101", "100"} and np.std([p.x for p in points]) >= np.std([p.y for p in points]) > 0
    run(spark, "visualize", f"{tmp_path}/run", "--dataset", data, "--out", f"{tmp_path}/some", "--group", 101, "--only", "--trained-only", "--metric", "euclidean")
    assert 0 < spark.read.option("header", True).option("sep", "\t").csv(f"{tmp_path}/some").count() < 15
    run(spark, "dim", data, "--run", f"{tmp_path}/run")
    assert "use" in capsys.readouterr().out


def test_audit_and_build_commands(spark, tmp_path, capsys):
    lines = lambda rows: "".join("\t|\t".join(map(str, r)) + "\t|\n" for r in rows)
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump/nodes.dmp").write_text(lines([(1, 1, "no rank"), (10, 1, "genus"), (11, 10, "species"), (12, 10, "species"), (13, 12, "species")]))
    (tmp_path / "dump/names.dmp").write_text(lines([(1, "root", "", "scientific name"), (10, "Alpha", "", "scientific name"), (11, "Alpha sp. x", "", "scientific name"), (12, "Alpha beta", "", "scientific name"), (13, "uncultured thing", "", "scientific name")]))
    run(spark, "audit", 10, "--dump", tmp_path / "dump", "--out", tmp_path / "audit")
    audited = spark.read.option("header", True).csv(f"{tmp_path}/audit/audit")
    assert audited.count() == 4 and "12" in [r.value for r in spark.read.text(f"{tmp_path}/audit/kept").collect()]
    for force in ([], [], ["--force"]):
        run(spark, "build", "10", "--dump", tmp_path / "dump", "--out", tmp_path / "data", *force)
    said = capsys.readouterr().out
    assert said.count("is there") == 1 and said.count("4 nodes") == 2


def test_p_of_correlations(spark):
    """Against Student's t, integrated by Simpson's rule, and known quantiles."""

    def tail(r, n):
        steps, low = 20_000, math.asin(abs(r))

        def area(a):
            w = (math.pi / 2 - a) / steps
            return w / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * max(math.cos(a + i * w), 0.0) ** (n - 3) for i in range(steps + 1))

        return area(low) / area(0.0)

    cases = [(0.0, 10), (0.5, 10), (-0.5, 10), (0.1, 1000), (0.9, 5), (0.03, 5000), (0.632, 10), (0.99, 4)]
    df = spark.createDataFrame([(float(r), n) for r, n in cases], "r double, n long")
    got = df.select("r", "n", correlation_p(F.col("r"), F.col("n")).alias("p")).collect()
    for x in got:
        assert x.p == pytest.approx(tail(x.r, x.n), rel=1e-6, abs=1e-12)
    assert [x.p for x in got if x.r == 0.632][0] == pytest.approx(0.05, abs=2e-4)  # the 5 % value of ten pairs
    odd = spark.createDataFrame([(1.0, 9), (-1.0, 9), (0.3, 2), (None, 50)], "r double, n long")
    assert [x.p for x in odd.select(correlation_p(F.col("r"), F.col("n")).alias("p")).collect()] == [0.0, 0.0, None, None]
    beta = spark.range(1).select(incomplete_beta(F.lit(2.0), F.lit(3.0), F.lit(0.4)).alias("b")).first().b
    assert beta == pytest.approx(0.5248, abs=1e-9)  # 1 - sum of binomial terms


def test_lines_of_several_splits_keep_their_numbers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = [[f"{i} {i + 1}" if i % 97 else f"bad {i}" for i in range(n)] for n in (5000, 1, 3000)]
    for k, lines in enumerate(texts):
        (tmp_path / f"in/{k}.txt").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = readers.numbered_lines(spark, f"{tmp_path}/in")
        rows = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = [x for t in texts for x in t]
    assert rows == list(enumerate(whole, 1))
    bad = C.validate_edgelist(got).select("line_no").collect()
    assert sorted(r.line_no for r in bad) == [i for i, x in enumerate(whole, 1) if x.startswith("bad")]


def test_gaps_and_warnings(spark, tmp_path):
    ids = spark.createDataFrame([(x,) for x in (-3, -2, 5, 6, 6, 9, None)], "v long")
    assert sorted(map(tuple, C.id_gaps(ids, "v").collect())) == [(-2, 5, 6), (6, 9, 2)]
    assert C.id_gaps(ids.where("v > 100"), "v").count() == 0
    path = writers.checkpoint(spark.createDataFrame([(0, [0.6, 0.8]), (1, [0.1, 0.1])], "idx int, vec array<double>"), {"loss": 1.0}, str(tmp_path), 1)
    with pytest.warns(UserWarning, match="1 of 2 vectors lie outside"):
        rows, seen = readers.checked_vectors(spark, f"{path}/vectors")
    assert rows.count() == 2 and seen["outside"] == 1


def test_projection_respects_the_ball(spark):
    """Points on two geodesics through a centre: the mean is the centre, and the coordinates are the distances from it."""
    centre = np.array([0.3, -0.2, 0.1])
    t = np.array([[s, 0, 0] for s in (-0.6, -0.3, 0.3, 0.6)] + [[0, s, 0] for s in (-0.2, 0.2)])
    x = np.array([R.exp_at(centre, v) for v in t])
    emb = spark.createDataFrame([(i, v.tolist(), "k") for i, v in enumerate(x)], "idx int, vec array<double>, x_label string")
    mean = R.frechet_mean(emb, 50)
    assert np.allclose(mean, centre, atol=1e-6) and np.allclose(R.log_at(centre, x), t, atol=1e-9)
    got = {r.idx: (r.x, r.y) for r in R.project(emb, rounds=50).collect()}
    assert np.allclose([got[i] for i in range(6)], t[:, :2], atol=1e-5)
    d = M._poincare_block(centre[None], x, True)[0]
    assert np.allclose(np.linalg.norm(t, axis=1) * 2 / (1 - centre @ centre), d, atol=1e-3)
    assert R.project(emb.limit(0)).count() == 0 and R.picture(emb.limit(1).select("idx", "vec"), emb.selectExpr("idx", "'a' label")).first().label == "a"
