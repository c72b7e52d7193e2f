"""Queries of reports: clustering, neighbours at several depths, summaries, dirty inputs, single functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import noise as X
from ..operators import pairs as P
from ..operators import sampling as S
from ..operators import training as L
from ..operators import tree as T
from ..operators import validate as C
from ..streaming.arrivals import pairs_by_difference
from ..tables import dense_index
from .queries import _DRAW, _HU, _HV, _KEYS, _NU, _NV, _SQ, _T, _UV, EMB, GEO, GROUP_PAIRS, NEAR, PAIRED, TWO, _geo_pairs, _geo_paths, _group_pairs, _r, _two
from .trees import CLOSURE_SQL, VECTORS_SQL, geo, geo_sql, scaled_vectors, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- vectors of tree nodes

BOTH = f"WITH RECURSIVE {geo_sql()}, {CLOSURE_SQL}, {VECTORS_SQL}, seat AS (SELECT 10000000 + o_orderkey AS taxid, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)"


def _seated(spark, sf_dir):
    """Vectors as those of orders: idx counts orders by key. (nodes, paths with idx, vectors)"""
    nodes, paths = _geo_paths(spark, sf_dir)
    seat = dense_index(table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 10_000_000).alias("taxid")), ["taxid"], "idx", "long")
    return nodes, paths.join(seat, "taxid"), scaled_vectors(spark, sf_dir)


def _clusters(rank, distance):
    return f"""{BOTH}, own AS (SELECT s.idx, n.taxid AS grp FROM seat s JOIN down ON d = s.taxid JOIN nodes n ON n.taxid = a AND n.rank = '{rank}'),
g AS (SELECT grp, row_number() OVER (ORDER BY grp) AS g FROM own JOIN emb USING (idx) GROUP BY grp HAVING count(*) >= 10),
s AS (SELECT g, idx, vec, row_number() OVER (PARTITION BY g ORDER BY idx) AS i FROM (SELECT g, idx, vec, row_number() OVER (PARTITION BY g ORDER BY md5('1|' || CAST(idx AS VARCHAR)), idx) AS r FROM emb JOIN own USING (idx) JOIN g USING (grp)) WHERE r <= 100),
two AS (SELECT true AS same, a.vec AS u, b.vec AS v FROM s a JOIN s b ON a.g = b.g AND b.i > a.i AND b.i < a.i + 20 UNION ALL SELECT false, a.vec, b.vec FROM s a JOIN s b ON a.i = 1 AND b.i = 1 AND b.g > a.g AND b.g < a.g + 10),
d AS (SELECT same, {distance} AS d FROM two), r AS (SELECT count(*) FILTER (same) AS n_intra, count(*) FILTER (NOT same) AS n_inter, avg(d) FILTER (NOT same) / avg(d) FILTER (same) AS ratio FROM d)
SELECT n_intra, n_inter, round(ratio, 6) AS ratio, CASE WHEN ratio > 2 THEN 'excellent' WHEN ratio > 1.5 THEN 'good' WHEN ratio > 1.2 THEN 'moderate' WHEN ratio IS NOT NULL THEN 'weak' ELSE 'N/A' END AS verdict FROM r"""


def _cluster(spark, sf_dir, rank, metric):
    nodes, paths, e = _seated(spark, sf_dir)
    groups = T.ancestor_at_rank(paths, nodes, rank).join(paths.select("taxid", "idx"), "taxid").select("idx", F.col("ancestor").alias("group"))
    return M.rank_clustering(e, groups, metric).select("n_intra", "n_inter", _r(F.col("ratio"), "ratio"), "verdict")


_BALL = f"acosh(1 + 2 * {_SQ} / ((1 - {_HU}) * (1 - {_HV}) + 1e-5) + 1e-5)"


@query(_clusters("nation", _BALL))
def clustering_at_nation(spark, sf_dir):
    return _cluster(spark, sf_dir, "nation", "poincare")


@query(_clusters("region", _BALL))
def clustering_at_region(spark, sf_dir):
    return _cluster(spark, sf_dir, "region", "poincare")


@query(_clusters("nation", f"sqrt({_SQ})"))
def clustering_at_nation_euclid(spark, sf_dir):
    return _cluster(spark, sf_dir, "nation", "euclid")


@query(_clusters("region", f"sqrt({_SQ})"))
def clustering_at_region_euclid(spark, sf_dir):
    return _cluster(spark, sf_dir, "region", "euclid")


@query(f"""{BOTH}, d AS (SELECT x.idx AS i, y.idx AS j, acosh(greatest(1 + 2 * s / ((1 - greatest(least(nu, 1 - 1e-5), 0)) * (1 - greatest(least(nv, 1 - 1e-5), 0)) + 1e-5), 1 + 1e-5)) AS d
 FROM emb x JOIN emb y ON x.idx <> y.idx, LATERAL (SELECT list_inner_product(x.vec, x.vec) AS nu, list_inner_product(y.vec, y.vec) AS nv, list_inner_product(list_transform(list_zip(x.vec, y.vec), lambda p: p[1] - p[2]), list_transform(list_zip(x.vec, y.vec), lambda p: p[1] - p[2])) AS s)),
near AS (SELECT i, j FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 10),
up AS (SELECT s.idx, x.depth, a AS anc FROM seat s JOIN down ON d = s.taxid JOIN depths x ON x.taxid = a WHERE x.depth BETWEEN 1 AND 3 UNION ALL SELECT idx, 4, taxid FROM seat)
SELECT CAST(p.depth AS INTEGER) AS depth, count(*) AS n, round(avg(CASE WHEN p.anc = q.anc THEN 1.0 ELSE 0.0 END), 6) AS purity FROM near JOIN up p ON p.idx = i JOIN up q ON q.idx = j AND q.depth = p.depth GROUP BY p.depth""")
def multiscale_ancestors(spark, sf_dir):
    _, paths, e = _seated(spark, sf_dir)
    return M.multiscale_knn(e, paths, (1, 2, 3, 4)).select("depth", "n", _r(F.col("purity"), "purity"))


@query(f"{EMB}, q AS (SELECT vec AS v FROM emb WHERE idx = 3), d AS (SELECT idx, vec AS u, v FROM emb, q WHERE idx <> 3) SELECT idx, round(sqrt({_SQ}), 6) AS distance FROM d ORDER BY sqrt({_SQ}), idx LIMIT 25")
def neighbors_of_one(spark, sf_dir):
    return M.euclidean_neighbors(scaled_vectors(spark, sf_dir), 3, 25).select("idx", _r(F.col("distance"), "distance"))


# ---------------------------------------------------------------- summaries


@query(f"{GROUP_PAIRS}, h AS (SELECT same, least(floor(d / (SELECT max(d) FROM d) * 50), 49) AS bin FROM d) SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n FROM h GROUP BY 1")
def histogram_of_distances(spark, sf_dir):
    return M.histogram(_group_pairs(spark, sf_dir), "d")


@query(f"{GROUP_PAIRS} SELECT same, count(*) AS n, round(min(d), 6) AS least, round(median(d), 6) AS median, round(max(d), 6) AS most FROM d GROUP BY same")
def summary_of_distances(spark, sf_dir):
    return M.distance_summary(_group_pairs(spark, sf_dir)).select("same", "n", *[_r(F.col(c), c) for c in ("least", "median", "most")])


@query(f"{EMB}, q AS (SELECT quantile_cont(depth, 0.25) AS a, quantile_cont(depth, 0.5) AS b, quantile_cont(depth, 0.75) AS c FROM norms) SELECT CASE WHEN depth <= a THEN 1 WHEN depth <= b THEN 2 WHEN depth <= c THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(min(norm), 6) AS least, round(avg(norm), 6) AS mean, round(max(norm), 6) AS most FROM norms, q GROUP BY 1")
def norms_by_depth_quartile(spark, sf_dir):
    return M.norm_by_quartile(M.norms(scaled_vectors(spark, sf_dir))).select("quartile", "n", *[_r(F.col(c), c) for c in ("least", "mean", "most")])


@query("SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, nation LIMIT 10")
def largest_groups(spark, sf_dir):
    return M.largest_groups(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), "nation", 10)


@query(f"{PAIRED}, c AS (SELECT d AS taxid, a AS class FROM down JOIN depths x ON x.taxid = a WHERE x.depth = 1 UNION ALL SELECT taxid, taxid FROM depths WHERE depth = 1) SELECT class, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pairs), 6) AS pct FROM pairs JOIN c ON c.taxid = descendant_taxid GROUP BY class")
def pairs_by_class(spark, sf_dir):
    _, paths, _, pairs = _geo_pairs(spark, sf_dir)
    rows = pairs.join(T.class_labels(paths).withColumnRenamed("taxid", "descendant_taxid"), "descendant_taxid")
    return M.shares(rows, "class").select("class", "n", _r(F.col("pct"), "pct"))


@query("WITH h AS (SELECT CAST(l_linenumber AS INTEGER) AS epoch, avg(CASE WHEN l_returnflag = 'N' THEN l_discount END) AS c, avg(CASE WHEN l_returnflag <> 'N' THEN l_discount END) AS d FROM lineitem GROUP BY 1) SELECT epoch, round(c, 6) AS clean, round(d, 6) AS dirty, round(c - d, 6) AS delta, round(100 * (c - d) / d, 5) AS delta_pct FROM h")
def clean_against_dirty(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("epoch", F.col("l_linenumber").cast("int"))
    history = lambda cond: rows.where(cond).groupBy("epoch").agg(F.avg("l_discount").alias("loss"))
    c = M.compare_histories(history("l_returnflag = 'N'"), history("l_returnflag <> 'N'"))
    return c.select("epoch", *[_r(F.col(x), x) for x in ("clean", "dirty", "delta")], F.round("delta_pct", 5).alias("delta_pct"))


@query(f"{GEO} SELECT count(DISTINCT parent) AS parents, count(DISTINCT child) AS children, (SELECT count(*) FROM (SELECT parent FROM edges UNION SELECT child FROM edges)) AS nodes FROM edges")
def edge_totals(spark, sf_dir):
    return C.edge_totals(T.edges_of(geo(spark, sf_dir)))


@query(f"{GEO} SELECT CAST(max(depth) AS INTEGER) AS deepest, round(avg(depth), 6) AS mean_depth FROM depths")
def depth_totals(spark, sf_dir):
    return _geo_paths(spark, sf_dir)[1].agg(F.max("depth").alias("deepest"), F.round(F.avg("depth"), 6).alias("mean_depth"))


# ---------------------------------------------------------------- trees and pairs


@query(f"{GEO}, keep AS (SELECT taxid FROM nodes WHERE taxid % 5 <> 2) SELECT a AS ancestor, d AS descendant FROM down JOIN keep x ON x.taxid = a JOIN keep y ON y.taxid = d")
def closure_of_reparented(spark, sf_dir):
    nodes, paths = _geo_paths(spark, sf_dir)
    fresh = X.reparent(paths, nodes.where("taxid % 5 <> 2").select("taxid")).where("parent is not null")
    return T.closure(T.node_paths(fresh.select("parent", F.col("taxid").alias("child")), 1)).select("ancestor", "descendant")


@query(f"{GEO} SELECT taxid, CASE WHEN taxid % 2 = 0 THEN name ELSE 'TaxID_' || taxid END AS name FROM nodes")
def named_nodes(spark, sf_dir):
    nodes = geo(spark, sf_dir)
    return T.named(nodes.select("taxid"), nodes.where("taxid % 2 = 0")).select("taxid", "name")


@query(f"{GEO} SELECT n.taxid, n.name, CAST(p.depth AS INTEGER) AS depth, n.parent FROM nodes n JOIN depths p ON p.taxid = n.taxid WHERE n.taxid % 4 = 1")
def nodes_of_valid_ids(spark, sf_dir):
    nodes, paths = _geo_paths(spark, sf_dir)
    valid = nodes.where("taxid % 4 = 1").select("taxid")
    return nodes.join(valid, "taxid", "left_semi").join(paths.select("taxid", "depth"), "taxid").select("taxid", "name", "depth", "parent")


@query(f"{GEO} SELECT e.parent, e.child, p.name AS parent_name, c.name AS child_name FROM edges e JOIN nodes p ON p.taxid = e.parent JOIN nodes c ON c.taxid = e.child")
def edges_with_objects(spark, sf_dir):
    nodes = geo(spark, sf_dir)
    return P.with_objects(T.edges_of(nodes), nodes)


@query(f"{PAIRED} SELECT depth_diff, count(*) AS n FROM pairs WHERE greatest(ancestor_idx, descendant_idx) <= (SELECT max(vec_id) FROM embeddings) GROUP BY depth_diff")
def pairs_within_bounds(spark, sf_dir):
    return P.within_bounds(_geo_pairs(spark, sf_dir)[3], scaled_vectors(spark, sf_dir)).groupBy("depth_diff").agg(F.count("*").alias("n"))


@query(f"{PAIRED} SELECT pos, ancestor_idx, descendant_idx FROM (SELECT *, row_number() OVER (ORDER BY ancestor_idx, descendant_idx) - 1 AS pos FROM pairs) WHERE pos IN (0, 7, 30, 31, 99)")
def pairs_at_positions(spark, sf_dir):
    at = spark.createDataFrame([(x,) for x in (0, 7, 30, 31, 99, 10**12)], "pos long")
    return P.at_positions(_geo_pairs(spark, sf_dir)[3], at, _KEYS).select("pos", *_KEYS)


@query(f"{GEO} SELECT parent, child FROM edges ORDER BY parent, child LIMIT 1000")
def first_edges(spark, sf_dir):
    return P.first_pairs(T.edges_of(geo(spark, sf_dir)), 1000, ["parent", "child"])


@query(f"{GEO} SELECT CAST(dd AS INTEGER) AS depth_diff, count(*) AS n FROM down WHERE d >= 10000000 GROUP BY dd")
def arrivals_by_difference(spark, sf_dir):
    """The streaming counts over all orders as one batch."""
    nodes, paths = _geo_paths(spark, sf_dir)
    new = nodes.where("rank = 'order'").select("taxid", "parent")
    return pairs_by_difference(new, paths.where("taxid < 10000000"))


@query(f"{PAIRED}, q AS (SELECT depth_diff, greatest(1, CAST(floor(777.0 * count(*) / (SELECT count(*) FROM pairs) + 1e-9) AS BIGINT)) AS quota FROM pairs GROUP BY 1), r AS (SELECT p.*, {_T(21, *_KEYS)} AS t, row_number() OVER (PARTITION BY depth_diff ORDER BY {_T(21, *_KEYS)}, ancestor_idx, descendant_idx) AS rn FROM pairs p), s AS (SELECT r.*, row_number() OVER (ORDER BY CASE WHEN rn > quota THEN 1 ELSE 0 END, t, ancestor_idx, descendant_idx) AS k FROM r JOIN q USING (depth_diff)) SELECT ancestor_idx, descendant_idx FROM s WHERE k <= 777")
def proportional_sample(spark, sf_dir):
    return S.proportional_sample(_geo_pairs(spark, sf_dir)[3], "depth_diff", 777, 21, _KEYS).select(*_KEYS)


def _eligible_sql(rows: str, links: str, k: int, seed: int, n: str, keys: list[str]) -> str:
    """Numbers of a row's choice in even stretches, moved past the links before them; rows(idx, weight, <keys>), links(idx, other, weight)."""
    own, key = ", ".join(keys), "".join(f", {c}" for c in keys)
    number = f"(lo + {_DRAW(seed, 'greatest(hi - lo, 1)', 'idx', *keys, 'no')})"
    again = _DRAW(seed, "greatest(may, 1)", "idx", *keys, "no")
    return f"""rows0 AS (SELECT * FROM ({rows})), held AS (SELECT idx, other, max(weight) AS weight FROM ({links}) WHERE idx <> other GROUP BY ALL),
barred AS (SELECT idx, other, row_number() OVER (PARTITION BY idx ORDER BY other) - 1 AS r, count(*) OVER (PARTITION BY idx) AS size FROM (SELECT idx, other FROM held UNION SELECT idx, idx FROM rows0)),
ranked AS (SELECT idx, other, weight, row_number() OVER (PARTITION BY idx ORDER BY weight, other) - 1 AS r, rank() OVER (PARTITION BY idx ORDER BY weight) - 1 AS light FROM held),
asked AS (SELECT w.*, {n} - size AS free, {n} - size + coalesce(light, 0) AS may FROM rows0 w JOIN (SELECT DISTINCT idx, size FROM barred) b USING (idx) LEFT JOIN (SELECT DISTINCT idx, weight, light FROM ranked) l ON l.idx = w.idx AND l.weight = w.weight),
each AS (SELECT idx{key}, free, may, no, CAST(floor(no * may / {k}) AS BIGINT) AS lo, CAST(floor((no + 1) * may / {k}) AS BIGINT) AS hi FROM asked, range({k}) t(no)),
drawn AS MATERIALIZED (SELECT idx{key}, no, free, CASE WHEN may = 0 THEN NULL WHEN may >= {k} THEN {number} WHEN no < may THEN no ELSE {again} END AS j FROM each),
gaps AS (SELECT idx, other - r AS gap, max(r) + 1 AS before FROM barred GROUP BY 1, 2),
met AS (SELECT d.*, g.before FROM drawn d ASOF LEFT JOIN gaps g ON d.idx = g.idx AND d.j >= g.gap)
SELECT idx{key}, CAST(no + 1 AS INTEGER) AS draw_no, CAST(CASE WHEN j IS NULL THEN idx WHEN j < free THEN j + coalesce(before, 0) ELSE other END AS INTEGER) AS negative_idx
FROM (SELECT m.*, h.other AS lit FROM met m LEFT JOIN (SELECT idx, other, r FROM ranked) h ON h.idx = m.idx AND h.r = m.j - m.free)""".replace("ELSE other END", "ELSE lit END")


@query(f"{PAIRED}, {_eligible_sql('SELECT idx, NULL::DOUBLE AS weight FROM mapping', 'SELECT descendant_idx AS idx, ancestor_idx AS other, 1.0 AS weight FROM pairs', 5, 22, '(SELECT count(*) FROM mapping)', []).replace('SELECT idx, CAST(no', 'SELECT idx AS descendant_idx, CAST(no')}")
def negatives_with_rejection(spark, sf_dir):
    _, _, mapping, pairs = _geo_pairs(spark, sf_dir)
    return S.rejecting_negatives(mapping, pairs.select(F.col("descendant_idx").alias("idx"), F.col("ancestor_idx").alias("negative_idx")), 5, 22)


#: Suppliers linked to the parts they delivered, by how often; parts and suppliers share the indices from 0.
_BOUGHT = "SELECT CAST(l_suppkey AS INTEGER) AS idx, CAST(l_partkey AS INTEGER) AS other, CAST(count(*) AS DOUBLE) AS weight FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY ALL"
_MOST = "(SELECT greatest(max(l_suppkey), max(l_partkey)) + 1 FROM lineitem)"


@query(f"WITH {_eligible_sql(f'SELECT * FROM ({_BOUGHT})', _BOUGHT, 6, 23, _MOST, ['other'])}")
def negatives_lighter_than_link(spark, sf_dir):
    """For each link, nodes that its source isn't linked to or by less weight."""
    items = table(spark, sf_dir, "lineitem")
    links = items.groupBy(F.col("l_suppkey").cast("int").alias("idx"), F.col("l_partkey").cast("int").alias("other")).agg(F.count("*").cast("double").alias("weight"))
    n = items.agg(F.greatest(F.max("l_suppkey"), F.max("l_partkey")) + 1).first()[0]
    return S.weight_rejecting_negatives(links, 6, 23, n)


@query(f"WITH v AS (SELECT vec_id AS idx FROM embeddings) SELECT idx, " + ", ".join(f"round((2 * ({_DRAW(7, 1 << 40, 'idx', str(k))}) / {float(1 << 40)} - 1) * 1e-3, 9) AS x{k}" for k in range(3)) + " FROM v")
def uniform_start(spark, sf_dir):
    v = L.uniform_vectors(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx")), 3)
    return v.select("idx", *[F.round(F.get("vec", F.lit(k)), 9).alias(f"x{k}") for k in range(3)])


# ---------------------------------------------------------------- dirty inputs


@query("SELECT o_orderkey AS line_no, CASE o_orderkey % 5 WHEN 1 THEN 'not a whole number' ELSE 'not two tokens' END AS issue FROM orders WHERE o_orderkey % 5 IN (1, 2, 3)")
def issues_of_edge_list(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    value = F.when(k == 1, "12 x7").when(k == 2, "5").when(k == 3, " 7 8 9").otherwise(" 3\t44 ")
    return C.validate_edgelist(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line_no"), value.alias("value")))


@query("""WITH m AS (SELECT CASE c_custkey % 10 WHEN 0 THEN 'bad' WHEN 1 THEN '7' ELSE CAST(c_custkey AS VARCHAR) END AS taxid, c_custkey % 50 AS idx FROM customer)
SELECT count(*) AS n, count(*) FILTER (taxid = 'bad') AS bad_taxids, (SELECT count(*) FROM (SELECT taxid FROM m GROUP BY taxid HAVING count(*) > 1)) AS repeated_taxid, (SELECT count(*) FROM (SELECT idx FROM m GROUP BY idx HAVING count(*) > 1)) AS repeated_idx, false AS is_dense FROM m""")
def issues_of_mapping(spark, sf_dir):
    k = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(F.when(k % 10 == 0, "bad").when(k % 10 == 1, "7").otherwise(k.cast("string")).alias("taxid"), (k % 50).alias("idx"))
    return C.validate_mapping(m)


@query(f"{PAIRED}, x AS (SELECT CASE WHEN descendant_idx % 50 = 0 THEN descendant_idx WHEN descendant_idx % 50 = 1 THEN -1 ELSE ancestor_idx END AS a, CASE WHEN descendant_idx % 50 = 2 THEN descendant_idx + 100000000 ELSE descendant_idx END AS d, CASE WHEN descendant_idx % 50 = 3 THEN 0 ELSE depth_diff END AS dd, ancestor_depth, descendant_depth FROM pairs), n AS (SELECT count(*) AS n FROM mapping) SELECT count(*) AS pairs, count(*) FILTER (a < 0 OR a >= n OR d < 0 OR d >= n) AS out_of_range, count(*) FILTER (a = d) AS self_pairs, count(*) FILTER (dd <> descendant_depth - ancestor_depth) AS inconsistent, count(*) FILTER (dd < 1) AS not_positive FROM x, n")
def issues_of_pairs(spark, sf_dir):
    *_, mapping, pairs = _geo_pairs(spark, sf_dir)
    k = F.col("descendant_idx") % 50
    dirty = pairs.select(
        F.when(k == 0, F.col("descendant_idx")).when(k == 1, F.lit(-1)).otherwise(F.col("ancestor_idx")).alias("ancestor_idx"), F.when(k == 2, F.col("descendant_idx") + 100_000_000).otherwise(F.col("descendant_idx")).alias("descendant_idx"),
        F.when(k == 3, F.lit(0)).otherwise(F.col("depth_diff")).alias("depth_diff"), "ancestor_depth", "descendant_depth",
    )
    return C.sanity(dirty, mapping)


# ---------------------------------------------------------------- functions


@query(f"{GEO} SELECT taxid, regexp_full_match(name, '[0-9]+') AS numeric FROM nodes")
def numeric_names(spark, sf_dir):
    return geo(spark, sf_dir).select("taxid", N.is_numeric(F.col("name")).alias("numeric"))


@query(f"{TWO} SELECT idx, round(greatest(sqrt({_SQ}) - {_NU} + 0.2, 0), 6) AS hinge, round({_UV} + {_NU} * 10 / 100 + {_NV} + (1.5 - 1), 6) AS quality FROM two")
def hinge_and_quality(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    score = V.quality_score(V.dot(u, v), V.squared_norm(u) * 10, V.squared_norm(v), F.lit(1.5))
    return _two(spark, sf_dir).select("idx", _r(V.hinge(F.sqrt(V.squared_distance(u, v)), V.squared_norm(u), F.lit(0.2)), "hinge"), _r(score, "quality"))


_X0, _Y0 = f"sqrt(1 + {_NU})", f"sqrt(1 + {_NV})"
_XY = f"least({_UV} - {_X0} * {_Y0}, -1 - 1e-15)"
_C = f"(acosh(-{_XY}) / sqrt({_XY} * {_XY} - 1))"


@query(f"{TWO} SELECT idx, round({_C} * ({_Y0} + {_XY} * {_X0}), 5) AS log0, round(v[1], 5) AS back, round({_C} * ({_Y0} + {_XY} * {_X0}) + {_C} * ({_XY} * {_XY} - 1) / (1 - {_XY}) * ({_X0} + {_Y0}), 5) AS carried0, round(-{_Y0} + ({_X0} * {_Y0} + {_UV}) * {_X0}, 5) AS gradient0 FROM two WHERE du > 0 AND dv > 0")
def lorentz_maps(spark, sf_dir):
    """The logarithm, its inverse, parallel transport and the gradient on the hyperboloid."""
    t = _two(spark, sf_dir).where("du > 0 and dv > 0").select("idx", V.lorentz_lift(F.col("u")).alias("x"), V.lorentz_lift(F.col("v")).alias("y"))
    t = t.withColumn("log", V.lorentz_log_map(F.col("x"), F.col("y")))
    first = lambda c, i=0: F.get(c, F.lit(i))
    back, carried = V.lorentz_exp_map(F.col("x"), F.col("log")), V.lorentz_transport(F.col("x"), F.col("y"), F.col("log"))
    gradient = V.lorentz_gradient(F.col("x"), F.col("y"))
    return t.select("idx", F.round(first(F.col("log")), 5).alias("log0"), F.round(first(back, 1), 5).alias("back"), F.round(first(carried), 5).alias("carried0"), F.round(first(gradient), 5).alias("gradient0"))


@query(f"{EMB} SELECT idx, round(least(norm * abs(1 - 0.3 * pow(1 - norm * norm, 2) / 4), 0.9 ), 6) AS norm FROM norms WHERE norm * abs(1 - 0.3 * pow(1 - norm * norm, 2) / 4) < 0.9")
def riemannian_step(spark, sf_dir):
    v = F.col("vec")
    stepped = scaled_vectors(spark, sf_dir).select("idx", V.norm(V.riemannian_step(v, v, 0.3)).alias("norm"))
    return stepped.where("norm < 0.9").select("idx", _r(F.col("norm"), "norm"))


_XU, _YU = f"sqrt(1 + {_NU})", f"sqrt(1 + {_NV})"
_DOT = f"({_UV} - {_XU} * {_YU})"
_HELD = "least(greatest({}, -1 + 1e-5), 1 - 1e-5)"
_RADIUS, _IMAGE = "(0.2 / (1 + sqrt(1.04)))", f"({_NU} / pow(1 + {_XU}, 2))"
_CONES = {
    "lorentz_aperture": "asin(" + _HELD.format(f"{_RADIUS} * (1 - {_IMAGE}) / sqrt({_IMAGE})") + ")",
    "lorentz_angle": "acos(" + _HELD.format(f"({_YU} + {_XU} * {_DOT}) / (sqrt({_NU}) * sqrt(greatest({_DOT} * {_DOT} - 1, 1e-5)))") + ")",
    "euclid_aperture": "asin(" + _HELD.format(f"{_RADIUS} / sqrt({_NU})") + ")",
    "euclid_angle": "acos(" + _HELD.format(f"({_NV} - {_NU} - {_SQ}) / (2 * sqrt({_NU}) * sqrt({_SQ}))") + ")",
}


@query(f"{TWO} SELECT idx, {', '.join(f'round({sql}, 5) AS {name}' for name, sql in _CONES.items())} FROM two WHERE du > 0 AND dv > 0")
def cones_of_manifolds(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    x, y = V.lorentz_lift(u), V.lorentz_lift(v)
    found = {"lorentz_aperture": V.lorentz_cone_aperture(x), "lorentz_angle": V.lorentz_cone_angle(x, y), "euclid_aperture": V.euclidean_cone_aperture(u), "euclid_angle": V.euclidean_cone_angle(u, v)}
    return _two(spark, sf_dir).where("du > 0 and dv > 0").select("idx", *[F.round(c, 5).alias(name) for name, c in found.items()])


@query(f"{TWO} SELECT idx, round(sqrt({_SQ}) + ln(exp(-sqrt({_SQ})) + exp(-sqrt({_NU})) + exp(-sqrt({_NV}))), 6) AS loss FROM two")
def softmax_of_distances(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    return _two(spark, sf_dir).select("idx", _r(V.distance_softmax(F.sqrt(V.squared_distance(u, v)), F.array(V.norm(u), V.norm(v))), "loss"))


@query(f"{EMB} SELECT idx, round(2 * atanh(tanh(norm / 2) * 0.7 + 0.3 * 0.5), 6) AS norm FROM norms WHERE depth > 0")
def tanh_nudge(spark, sf_dir):
    nudged = V.norm(V.tanh_radial_nudge(F.col("vec"), F.lit(0.5), 0.3))
    return scaled_vectors(spark, sf_dir).where("depth > 0").select("idx", _r(nudged, "norm"))


# ---------------------------------------------------------------- significance and verdicts

#: p as a share of the integral of cos^(n - 3), by Simpson's rule over 20,000 stretches.
_TAIL = "(SELECT sum(CASE WHEN i % 20000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos({low} + (pi() / 2 - {low}) * i / 20000), 0), n - 3)) * (pi() / 2 - {low}) FROM range(20001) t(i))"
_P = lambda r: f"({_TAIL.format(low=f'asin(abs({r}))')} / {_TAIL.format(low='0.0')})"


@query(f"WITH r AS (SELECT p_size AS x, p_retailprice AS y, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part), c AS (SELECT count(*) AS n, corr(x, y) AS pearson, corr(a, b) AS spearman FROM r) SELECT n, round(pearson, 6) AS pearson, round({_P('pearson')}, 6) AS pearson_p, round(spearman, 6) AS spearman, round({_P('spearman')}, 6) AS spearman_p, CASE WHEN pearson > 0.5 THEN 'good' WHEN pearson > 0.3 THEN 'weak' WHEN pearson > 0 THEN 'poor' ELSE 'broken' END AS verdict FROM c")
def correlation_report(spark, sf_dir):
    r = M.correlation_report(table(spark, sf_dir, "part").select("p_size", F.col("p_retailprice").cast("double").alias("price")), "p_size", "price")
    return r.select("n", *[_r(F.col(c), c) for c in ("pearson", "pearson_p", "spearman", "spearman_p")], "verdict")


@query(f"{EMB}, q AS (SELECT quantile_cont(norm, [0.5, 0.9, 0.99]) AS a, quantile_cont(norm * 0.7 + 0.15, [0.5, 0.9, 0.99]) AS b FROM norms) SELECT CAST([0.5, 0.9, 0.99][i] AS DOUBLE) AS p, round(a[i], 6) AS before, round(b[i], 6) AS after, round(b[i] - a[i], 6) AS delta FROM q, range(1, 4) t(i)")
def percentile_comparison(spark, sf_dir):
    e = scaled_vectors(spark, sf_dir)
    after = e.withColumn("vec", V.radial_nudge(F.col("vec"), F.lit(0.5), 0.3))
    return M.compare_percentiles(e, after).select("p", *[_r(F.col(c), c) for c in ("before", "after", "delta")])


@query(f"{EMB} SELECT count(*) AS n, round(100 * avg(CASE WHEN norm >= 0.7 THEN 1.0 ELSE 0.0 END), 6) AS close_pct, round(max(norm), 6) AS most, max(norm) < 1 AS inside FROM norms")
def boundary_report(spark, sf_dir):
    return M.boundary_report(scaled_vectors(spark, sf_dir), 0.7).select("n", _r(F.col("close_pct"), "close_pct"), _r(F.col("most"), "most"), "inside")


@query(f"{PAIRED}, bad AS (SELECT count(*) AS k FROM pairs WHERE descendant_idx % 9 = 4) SELECT * FROM (VALUES ('one index an id', 0), ('one id an index', 0), ('no gaps', 0), ('ends are mapped', 0), ('no self pairs', (SELECT k FROM bad)), ('depths agree', 0), ('edges are pairs', (SELECT count(*) FROM pairs WHERE descendant_idx % 9 = 4 AND depth_diff = 1)), ('inside the ball', 0), ('at the target radius', (SELECT count(*) FROM mapping WHERE idx % 11 = 3)), ('negatives are others', (SELECT count(*) FROM pairs WHERE descendant_idx % 9 = 5))) t(\"check\", bad)")
def ten_checks(spark, sf_dir):
    """A dataset with faults of three kinds: pairs turned into self pairs, vectors off their radius, negatives that are the node."""
    nodes, paths, mapping, pairs = _geo_pairs(spark, sf_dir)
    k = F.col("descendant_idx") % 9
    dirty = pairs.withColumn("ancestor_idx", F.when(k == 4, F.col("descendant_idx")).otherwise(F.col("ancestor_idx")))
    links = pairs.select("ancestor_idx", "descendant_idx", F.array(F.when(k == 5, F.col("descendant_idx")).otherwise(F.lit(-1))).alias("negatives"))
    depths = paths.join(mapping, "taxid").select("idx", "depth")
    target = V.target_radius(F.col("depth").cast("double"), F.lit(4.0))
    start = L.initial_vectors(depths, 4, 4).withColumn("target", F.when(F.col("idx") % 11 == 3, 0.99).otherwise(target))
    return C.ten_checks(T.edges_of(nodes), mapping, dirty, start, links)
