"""Queries over the derived trees and vectors, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import vectors as V
from ..operators import metrics as M
from ..operators import noise as X
from ..operators import pairs as P
from ..operators import sampling as S
from ..operators import tree as T
from ..operators import validate as C
from .trees import CLOSURE_SQL, PART_NOISE, PARTS_SQL, VECTORS_SQL, geo, geo_sql, parts, scaled_vectors, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
GEO = f"WITH RECURSIVE {geo_sql()}, {CLOSURE_SQL}"
PARTS = f"WITH RECURSIVE {PARTS_SQL}, {CLOSURE_SQL}"
MAPPED = f"{GEO}, mapping AS (SELECT taxid, CAST(row_number() OVER (ORDER BY taxid) - 1 AS INTEGER) AS idx FROM nodes)"
PAIRED = f"""{MAPPED}, pairs AS (SELECT ma.idx AS ancestor_idx, md.idx AS descendant_idx, CAST(dd AS INTEGER) AS depth_diff, CAST(da.depth AS INTEGER) AS ancestor_depth, CAST(d2.depth AS INTEGER) AS descendant_depth, a AS ancestor_taxid, d AS descendant_taxid
 FROM down JOIN mapping ma ON ma.taxid = a JOIN mapping md ON md.taxid = d JOIN depths da ON da.taxid = a JOIN depths d2 ON d2.taxid = d)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _geo_paths(spark, sf_dir, orders=True):
    nodes = geo(spark, sf_dir, orders)
    return nodes, T.node_paths(T.edges_of(nodes), 1)


def _part_paths(spark, sf_dir):
    nodes = parts(spark, sf_dir)
    return nodes, T.node_paths(T.edges_of(nodes), 1)


def _geo_pairs(spark, sf_dir):
    nodes, paths = _geo_paths(spark, sf_dir)
    mapping = P.dense_mapping(nodes)
    return nodes, paths, mapping, P.pair_table(paths, mapping)


# ---------------------------------------------------------------- trees


@query(f"{GEO} SELECT a AS ancestor, d AS descendant, CAST(dd AS INTEGER) AS depth_diff, CAST(x.depth AS INTEGER) AS ancestor_depth, CAST(y.depth AS INTEGER) AS descendant_depth FROM down JOIN depths x ON x.taxid = a JOIN depths y ON y.taxid = d")
def closure_pairs(spark, sf_dir):
    return T.closure(_geo_paths(spark, sf_dir)[1])


@query(f"{GEO} SELECT CAST(dd AS INTEGER) AS depth_diff, count(*) AS n FROM down GROUP BY dd")
def closure_hist(spark, sf_dir):
    return T.closure(_geo_paths(spark, sf_dir)[1]).groupBy("depth_diff").agg(F.count("*").alias("n"))


@query(f"{GEO}, b AS (SELECT CASE WHEN dd <= 1 THEN '1' WHEN dd = 2 THEN '2' WHEN dd <= 5 THEN '3-5' WHEN dd <= 10 THEN '6-10' ELSE '>10' END AS bin, dd FROM down) SELECT bin, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM b), 6) AS pct, CAST(min(dd) AS INTEGER) AS least, CAST(max(dd) AS INTEGER) AS most FROM b GROUP BY bin")
def closure_bins(spark, sf_dir):
    return P.depth_bins(T.closure(_geo_paths(spark, sf_dir)[1]))


@query(f"{GEO} SELECT taxid, CAST(depth AS INTEGER) AS depth FROM depths")
def node_depth(spark, sf_dir):
    return _geo_paths(spark, sf_dir)[1].select("taxid", "depth")


@query(f"{GEO} SELECT d AS taxid, string_agg(CAST(a AS VARCHAR), ',' ORDER BY dd) AS ancestors FROM down GROUP BY d")
def ancestors_list(spark, sf_dir):
    return T.ancestors(_geo_paths(spark, sf_dir)[1]).where("size(ancestors) > 0").select("taxid", F.array_join("ancestors", ",").alias("ancestors"))


@query(f"{GEO} SELECT CAST(10 AS BIGINT) AS taxid, 0 AS depth UNION ALL SELECT d, CAST(dd AS INTEGER) FROM down WHERE a = 10")
def subtree_nodes(spark, sf_dir):
    return T.subtree(_geo_paths(spark, sf_dir)[1], 10)


@query(f"{GEO} SELECT taxid, CAST(depth AS INTEGER) AS depth FROM depths WHERE depth <= 2")
def subtree_depth_cap(spark, sf_dir):
    return T.node_paths(T.edges_of(geo(spark, sf_dir)), 1, max_depth=2).select("taxid", "depth")


@query(f"{GEO} SELECT taxid, 1 + (SELECT count(*) FROM down WHERE a = taxid) AS subtree_size FROM nodes")
def subtree_sizes(spark, sf_dir):
    return T.subtree_sizes(_geo_paths(spark, sf_dir)[1])


@query(f"{GEO} SELECT d AS taxid, a AS class FROM down JOIN depths x ON x.taxid = a WHERE x.depth = 1 UNION ALL SELECT taxid, taxid FROM depths WHERE depth = 1")
def class_labels(spark, sf_dir):
    return T.class_labels(_geo_paths(spark, sf_dir)[1])


@query(f"{GEO} SELECT d AS taxid, a AS grandparent FROM down WHERE dd = 2")
def grandparent(spark, sf_dir):
    return T.grandparents(_geo_paths(spark, sf_dir)[1])


@query(f"{GEO} SELECT n.taxid, CASE WHEN n.rank = 'nation' THEN n.taxid ELSE u.a END AS ancestor FROM nodes n LEFT JOIN (SELECT d, a FROM down JOIN nodes x ON x.taxid = a WHERE x.rank = 'nation') u ON u.d = n.taxid")
def ancestor_at_rank(spark, sf_dir):
    nodes, paths = _geo_paths(spark, sf_dir)
    return T.ancestor_at_rank(paths, nodes, "nation")


@query(f"{GEO} SELECT p.taxid, CASE WHEN p.depth = 2 THEN p.taxid ELSE u.a END AS ancestor FROM depths p LEFT JOIN (SELECT d, a FROM down JOIN depths x ON x.taxid = a WHERE x.depth = 2) u ON u.d = p.taxid")
def ancestor_at_depth(spark, sf_dir):
    return _geo_paths(spark, sf_dir)[1].select("taxid", T.ancestor_at(2).alias("ancestor"))


@query(f"{GEO} SELECT d AS taxid FROM down WHERE a = 12 AND dd = 2")
def nodes_at_level(spark, sf_dir):
    return T.subtree(_geo_paths(spark, sf_dir)[1], 12).where("depth = 2").select("taxid")


GROUPS = "groups(label, root, priority) AS (VALUES ('R10', 10, 1), ('N105', 105, 0), ('R11', 11, 2), ('R12', 12, 3))"
HELD = "held AS (SELECT label, priority, root AS taxid FROM groups UNION ALL SELECT label, priority, d FROM groups JOIN down ON a = root)"


def _groups(spark):
    return F.broadcast(spark.createDataFrame([("R10", 10, 1), ("N105", 105, 0), ("R11", 11, 2), ("R12", 12, 3)], "label string, root long, priority int"))


@query(f"{GEO}, {GROUPS}, {HELD} SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM nodes), 6) AS pct FROM held GROUP BY label")
def group_members(spark, sf_dir):
    _, paths = _geo_paths(spark, sf_dir)
    counts = T.group_members(paths, _groups(spark)).groupBy("label").agg(F.count("*").alias("n"))
    total = F.broadcast(paths.agg(F.count("*").alias("t")))
    return counts.join(total, F.lit(True)).select("label", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("pct"))


@query(f"{GEO}, {GROUPS}, {HELD} SELECT n.taxid, coalesce(arg_min(label, priority), 'Other') AS label FROM nodes n LEFT JOIN held h ON h.taxid = n.taxid GROUP BY n.taxid")
def group_first_match(spark, sf_dir):
    return T.first_group(_geo_paths(spark, sf_dir)[1], _groups(spark))


@query(f"{GEO} SELECT DISTINCT parent AS taxid FROM edges WHERE parent NOT IN (SELECT child FROM edges)")
def tree_roots(spark, sf_dir):
    return T.roots(T.edges_of(geo(spark, sf_dir)))


@query(f"{GEO} SELECT child AS taxid FROM edges WHERE child NOT IN (SELECT parent FROM edges)")
def leaf_nodes(spark, sf_dir):
    return T.leaves(T.edges_of(geo(spark, sf_dir)))


@query(f"{GEO} SELECT parent, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS neighbors FROM edges GROUP BY parent")
def children_lists(spark, sf_dir):
    return T.adjacency(T.edges_of(geo(spark, sf_dir))).select("parent", F.array_join("neighbors", ",").alias("neighbors"))


@query(f"{GEO} SELECT parent, count(*) AS n_children, min(child) AS first_child, max(child) AS last_child FROM edges GROUP BY parent")
def children_counts(spark, sf_dir):
    return T.children_counts(T.edges_of(geo(spark, sf_dir)))


@query(f"{GEO} SELECT min(taxid) AS taxid, min(name) AS name FROM nodes WHERE name = 'NATION_5' UNION ALL SELECT taxid, name FROM nodes WHERE taxid = 12")
def resolve_name(spark, sf_dir):
    nodes = geo(spark, sf_dir)
    return T.resolve(nodes, "NATION_5").unionByName(T.resolve(nodes, "12"))


# ---------------------------------------------------------------- indices and pairs


@query(f"{MAPPED} SELECT taxid, idx FROM mapping")
def dense_mapping(spark, sf_dir):
    return P.dense_mapping(geo(spark, sf_dir))


@query(f"{GEO}, f AS (SELECT taxid, min(pos) AS place FROM (SELECT parent AS taxid, 2 * child AS pos FROM edges UNION ALL SELECT child, 2 * child + 1 FROM edges) GROUP BY taxid) SELECT taxid, CAST(row_number() OVER (ORDER BY place) - 1 AS INTEGER) AS idx FROM f")
def first_seen_mapping(spark, sf_dir):
    return P.first_seen_mapping(T.edges_of(geo(spark, sf_dir)).withColumn("pos", F.col("child")))


@query(f"{PAIRED} SELECT * FROM pairs")
def pair_table(spark, sf_dir):
    return _geo_pairs(spark, sf_dir)[3]


@query(f"{MAPPED} SELECT p.idx AS parent_idx, c.idx AS child_idx FROM edges JOIN mapping p ON p.taxid = parent JOIN mapping c ON c.taxid = child")
def mapped_edges(spark, sf_dir):
    nodes = geo(spark, sf_dir)
    return P.mapped_edges(T.edges_of(nodes), P.dense_mapping(nodes))


@query(f"{GEO} SELECT count(*) AS total, count(*) FILTER (a % 3 <> 0 AND d % 3 <> 0) AS kept, count(*) FILTER (NOT (a % 3 <> 0 AND d % 3 <> 0)) AS skipped FROM down")
def skipped_pairs(spark, sf_dir):
    nodes, paths = _geo_paths(spark, sf_dir)
    return P.skipped_pairs(paths, P.dense_mapping(nodes.where("taxid % 3 <> 0")))


USED = "used AS (SELECT ancestor_idx AS idx FROM pairs WHERE depth_diff = 2 UNION SELECT descendant_idx FROM pairs WHERE depth_diff = 2)"


@query(f"{PAIRED}, {USED} SELECT count(*) AS total_nodes, count(u.idx) AS used_nodes, count(*) - count(u.idx) AS missing_nodes, count(u.idx) / count(*) AS coverage_ratio FROM mapping m LEFT JOIN used u ON u.idx = m.idx")
def coverage_report(spark, sf_dir):
    *_, mapping, pairs = _geo_pairs(spark, sf_dir)
    return P.coverage(mapping, P.used_indices(pairs.where("depth_diff = 2")))


@query(f"{PAIRED}, used AS (SELECT ancestor_idx AS idx FROM pairs WHERE depth_diff = 3 AND descendant_taxid % 3 = 0 UNION SELECT descendant_idx FROM pairs WHERE depth_diff = 3 AND descendant_taxid % 3 = 0) SELECT idx, taxid FROM mapping WHERE idx NOT IN (SELECT idx FROM used)")
def coverage_missing(spark, sf_dir):
    *_, mapping, pairs = _geo_pairs(spark, sf_dir)
    return P.missing(mapping, P.used_indices(pairs.where("depth_diff = 3 and descendant_taxid % 3 = 0"))).select("idx", "taxid")


@query(f"{PAIRED}, few AS (SELECT * FROM pairs WHERE descendant_taxid % 3 = 0), used AS (SELECT ancestor_idx AS idx FROM few UNION SELECT descendant_idx FROM few) SELECT * FROM few UNION ALL SELECT coalesce(p.idx, m.idx), m.idx, CASE WHEN p.idx IS NULL THEN 0 ELSE 1 END, CAST(coalesce(dp.depth, dm.depth) AS INTEGER), CAST(dm.depth AS INTEGER), coalesce(p.taxid, m.taxid), m.taxid FROM mapping m LEFT JOIN edges e ON e.child = m.taxid LEFT JOIN mapping p ON p.taxid = e.parent LEFT JOIN depths dp ON dp.taxid = p.taxid LEFT JOIN depths dm ON dm.taxid = m.taxid WHERE m.idx NOT IN (SELECT idx FROM used)")
def coverage_repair(spark, sf_dir):
    nodes, paths, mapping, pairs = _geo_pairs(spark, sf_dir)
    return P.repair_coverage(pairs.where("descendant_taxid % 3 = 0"), mapping, T.edges_of(nodes), paths)


@query(f"{PAIRED} SELECT idx, min(depth) AS depth FROM (SELECT ancestor_idx AS idx, ancestor_depth AS depth FROM pairs UNION SELECT descendant_idx, descendant_depth FROM pairs) GROUP BY idx")
def index_depths(spark, sf_dir):
    return P.depth_of_indices(_geo_pairs(spark, sf_dir)[3])


@query(f"{PAIRED} SELECT count(*) AS pairs, max(greatest(ancestor_idx, descendant_idx)) + 1 AS n_nodes, max(descendant_depth) AS max_depth FROM pairs")
def pair_totals(spark, sf_dir):
    pairs = _geo_pairs(spark, sf_dir)[3]
    return pairs.agg(F.count("*").alias("pairs"), (F.max(F.greatest("ancestor_idx", "descendant_idx")) + 1).alias("n_nodes"), F.max("descendant_depth").alias("max_depth"))


@query(f"{GEO} SELECT id1, id2, count(*) AS n FROM (SELECT parent AS id1, child AS id2 FROM edges UNION ALL SELECT child, parent FROM edges) GROUP BY id1, id2")
def symmetrize(spark, sf_dir):
    e = T.edges_of(geo(spark, sf_dir)).select(F.col("parent").alias("id1"), F.col("child").alias("id2"), F.lit(1.0).alias("weight"))
    return P.symmetrized(e).groupBy("id1", "id2").agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS id, CAST(count(*) AS DOUBLE) AS count, round(pow(count(*), 0.75), 6) AS weight FROM orders GROUP BY o_custkey")
def unigram_weights(spark, sf_dir):
    cooc = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id1"), F.col("o_custkey").alias("id2"), F.lit(1.0).alias("weight"))
    return P.unigram_weights(cooc).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- noise

_R = lambda col, p: f"coalesce(regexp_matches({col}, '{p}', 'i'), false)"
NOISY = "CASE WHEN " + " THEN 'x' WHEN ".join(_R("name", p) for _, p in PART_NOISE) + " THEN 'x' END"
CATS = "list_filter([" + ", ".join(f"CASE WHEN {_R('name', p)} THEN '{c}' END" for c, p in PART_NOISE) + "], lambda x: x IS NOT NULL)"
FLAGGED = f"{PARTS}, flagged AS (SELECT *, array_to_string({CATS}, '|') AS cats, {_R('name', '^unclassified\\s')} AS container FROM nodes)"
KEPT = "kept AS (SELECT DISTINCT x.taxid FROM (SELECT taxid FROM good UNION ALL SELECT a FROM down JOIN good ON good.taxid = d) x)"
PRUNED = f"{FLAGGED}, good AS (SELECT taxid FROM flagged WHERE (cats = '' AND NOT container AND name IS NOT NULL) OR taxid = 1), {KEPT}"
AUDITED = f"""{FLAGGED}, good AS (SELECT taxid FROM flagged WHERE cats = '' AND NOT container AND rank IS NOT NULL), {KEPT},
audited AS (SELECT taxid, name, coalesce(rank, 'unknown') AS rank, 1 + (SELECT count(*) FROM down WHERE a = f.taxid) AS subtree_size, cats AS noise_categories, cats <> '' AS is_flagged, taxid NOT IN (SELECT taxid FROM kept) AS is_removed,
 CASE WHEN taxid IN (SELECT taxid FROM kept) THEN '' WHEN cats <> '' THEN cats WHEN rank IS NULL THEN 'stale_taxid' ELSE 'empty_container:unclassified' END AS removal_reason FROM flagged f)"""


def _audit(spark, sf_dir):
    nodes, paths = _part_paths(spark, sf_dir)
    return X.audit(paths, nodes, noise=PART_NOISE)


@query(f"{FLAGGED} SELECT taxid, cats AS noise_categories, CASE WHEN container THEN 'unclassified' END AS container_category FROM flagged")
def noise_flags(spark, sf_dir):
    return X.flags(parts(spark, sf_dir), PART_NOISE).select("taxid", F.array_join("noise_categories", "|").alias("noise_categories"), "container_category")


@query("SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '{p}', 'i'), false) AS c{i}" for i, (_, p) in enumerate(N.NOISE)) + " FROM documents")
def name_noise_classes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    cats = N.noise_categories(F.col("text"))
    return d.select("doc_id", *[F.array_contains(cats, c).alias(f"c{i}") for i, (c, _) in enumerate(N.NOISE)])


@query(f"{PRUNED} SELECT k.taxid, CAST(depth AS INTEGER) AS depth FROM kept k JOIN depths p ON p.taxid = k.taxid")
def noise_prune(spark, sf_dir):
    nodes, paths = _part_paths(spark, sf_dir)
    return X.prune(paths, nodes, 1, noise=PART_NOISE).select("taxid", "depth")


@query(f"{AUDITED} SELECT * FROM audited")
def noise_audit(spark, sf_dir):
    return _audit(spark, sf_dir)


@query(f"{AUDITED} SELECT category, count(*) AS n FROM (SELECT unnest(string_split(noise_categories, '|')) AS category FROM audited WHERE is_flagged) GROUP BY category")
def noise_counts(spark, sf_dir):
    return X.noise_counts(_audit(spark, sf_dir))


@query(f"{AUDITED} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(removal_reason, '|')) AS reason FROM audited WHERE is_removed) GROUP BY reason")
def reason_counts(spark, sf_dir):
    return X.reason_counts(_audit(spark, sf_dir))


@query(f"{AUDITED} SELECT reason, CAST(rn AS INTEGER) AS rn, name FROM (SELECT reason, name, row_number() OVER (PARTITION BY reason ORDER BY taxid) AS rn FROM (SELECT unnest(string_split(removal_reason, '|')) AS reason, taxid, name FROM audited WHERE is_removed)) WHERE rn <= 5")
def reason_examples(spark, sf_dir):
    return X.reason_examples(_audit(spark, sf_dir))


@query(f"{AUDITED} SELECT rank, count(*) AS n, count(*) FILTER (is_removed) AS removed, round(100.0 * count(*) FILTER (is_removed) / count(*), 6) AS removed_pct FROM audited GROUP BY rank ORDER BY n DESC, rank LIMIT 15")
def rank_distribution(spark, sf_dir):
    return X.rank_distribution(_audit(spark, sf_dir))


@query(f"{PRUNED} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS before, count(k.taxid) AS after FROM depths p LEFT JOIN kept k ON k.taxid = p.taxid GROUP BY depth")
def depth_before_after(spark, sf_dir):
    nodes, paths = _part_paths(spark, sf_dir)
    return X.depth_before_after(paths, X.prune(paths, nodes, 1, noise=PART_NOISE))


@query(f"{GEO}, keep AS (SELECT taxid FROM nodes WHERE taxid % 5 <> 1), up AS (SELECT d, a, dd FROM down JOIN keep x ON x.taxid = a JOIN keep y ON y.taxid = d) SELECT k.taxid, arg_min(a, dd) AS parent, CAST(count(a) AS INTEGER) AS depth FROM keep k LEFT JOIN up ON d = k.taxid GROUP BY k.taxid")
def reparent_allowlist(spark, sf_dir):
    nodes, paths = _geo_paths(spark, sf_dir)
    return X.reparent(paths, nodes.where("taxid % 5 <> 1").select("taxid"))


@query("SELECT c_custkey, coalesce(nullif(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'clade') AS slug, coalesce(nullif(trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'clade') || '_' || c_custkey || '_d3_clean' AS dataset FROM customer")
def slugify(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", N.slugify(F.col("c_name")).alias("slug"), N.dataset_name(F.col("c_name"), F.col("c_custkey"), F.lit(3), F.lit(True)).alias("dataset"))


# ---------------------------------------------------------------- validation


@query(f"{PAIRED} SELECT count(*) AS n, CAST(0 AS BIGINT) AS bad_taxids, CAST(0 AS BIGINT) AS repeated_taxid, CAST(0 AS BIGINT) AS repeated_idx, min(idx) = 0 AND max(idx) = count(*) - 1 AS is_dense FROM mapping")
def validate_mapping(spark, sf_dir):
    return C.validate_mapping(P.dense_mapping(geo(spark, sf_dir)))


@query(f"{GEO}, m AS (SELECT taxid FROM nodes WHERE taxid % 7 <> 3 OR taxid < 100 UNION ALL SELECT 5), u AS (SELECT parent AS taxid FROM edges UNION SELECT child FROM edges) SELECT (SELECT count(*) FROM u) AS edge_nodes, (SELECT count(*) FROM u WHERE taxid NOT IN (SELECT taxid FROM m)) AS unmapped, (SELECT count(*) FROM m) AS mapped, (SELECT count(*) FROM m WHERE taxid NOT IN (SELECT taxid FROM u)) AS unused")
def validate_consistency(spark, sf_dir):
    nodes = geo(spark, sf_dir)
    ids = nodes.where("taxid % 7 <> 3 or taxid < 100").select("taxid").unionByName(spark.createDataFrame([(5,)], "taxid long"))
    return C.validate_consistency(T.edges_of(nodes), ids)


@query(f"{PAIRED} SELECT count(*) AS pairs, CAST(0 AS BIGINT) AS out_of_range, count(*) FILTER (ancestor_idx = descendant_idx) AS self_pairs, count(*) FILTER (depth_diff <> descendant_depth - ancestor_depth) AS inconsistent, count(*) FILTER (depth_diff < 1) AS not_positive FROM pairs")
def sanity_row(spark, sf_dir):
    *_, mapping, pairs = _geo_pairs(spark, sf_dir)
    return C.sanity(pairs, mapping)


@query(f"{PAIRED}, r AS (SELECT m.idx, EXISTS (SELECT 1 FROM pairs WHERE ancestor_idx = m.idx AND depth_diff = 1) AS a, EXISTS (SELECT 1 FROM pairs WHERE descendant_idx = m.idx AND depth_diff = 1) AS d FROM mapping m) SELECT CASE WHEN a AND d THEN 'both' WHEN a THEN 'ancestor' WHEN d THEN 'descendant' ELSE 'never' END AS role, count(*) AS n FROM r GROUP BY 1")
def node_roles(spark, sf_dir):
    *_, mapping, pairs = _geo_pairs(spark, sf_dir)
    return C.node_roles(pairs.where("depth_diff = 1"), mapping)


# ---------------------------------------------------------------- geometry

EMB = f"WITH {VECTORS_SQL}"
TWO = f"{EMB}, two AS (SELECT x.idx, x.vec AS u, y.vec AS v, x.depth AS du, y.depth AS dv FROM emb x JOIN emb y ON y.idx = x.idx + 1)"
_SQ = "list_inner_product(list_transform(list_zip(u, v), lambda p: p[1] - p[2]), list_transform(list_zip(u, v), lambda p: p[1] - p[2]))"
_NU, _NV, _UV = "list_inner_product(u, u)", "list_inner_product(v, v)", "list_inner_product(u, v)"
_HU, _HV = f"greatest(least({_NU}, 1 - 1e-5), 0)", f"greatest(least({_NV}, 1 - 1e-5), 0)"


def _two(spark, sf_dir):
    e = scaled_vectors(spark, sf_dir)
    after = e.select((F.col("idx") - 1).alias("idx"), F.col("vec").alias("v"), F.col("depth").alias("dv"))
    return e.select("idx", F.col("vec").alias("u"), F.col("depth").alias("du")).join(after, "idx")


def _r(c, name):
    return F.round(c, 6).alias(name)


@query(f"{TWO} SELECT idx, round(acosh(1 + 2 * {_SQ} / ((1 - {_HU}) * (1 - {_HV}) + 1e-5) + 1e-5), 6) AS model, round(acosh(greatest(1 + 2 * {_SQ} / ((1 - {_HU}) * (1 - {_HV}) + 1e-5), 1 + 1e-5)), 6) AS clamped, round(acosh(1 + 2 * {_SQ} / ((1 - {_NU}) * (1 - {_NV}))), 6) AS exact FROM two")
def poincare_distance(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    return _two(spark, sf_dir).select("idx", *[_r(V.poincare_distance(u, v, k), k) for k in ("model", "clamped", "exact")])


@query(f"{EMB} SELECT idx, round(0.1 + 0.85 * depth / 4, 6) AS linear, round(0.1 + 0.85 * ln(1 + depth) / ln(5), 6) AS log FROM emb")
def target_radius(spark, sf_dir):
    d = F.col("depth").cast("double")
    return scaled_vectors(spark, sf_dir).select("idx", _r(V.target_radius(d, F.lit(4.0)), "linear"), _r(V.target_radius(d, F.lit(4.0), "log"), "log"))


@query(f"{EMB} SELECT idx, round(least(norm, 0.9 * norm / (norm + 1e-8)), 6) AS projected, round(tanh(norm / 2), 6) AS mapped, round(2 * atanh(norm), 6) AS lifted, round(norm * 0.7 + 0.3 * 0.5, 6) AS nudged FROM norms")
def ball_maps(spark, sf_dir):
    e, v = scaled_vectors(spark, sf_dir), F.col("vec")
    return e.select("idx", _r(V.norm(V.project_to_ball(v, 0.9)), "projected"), _r(V.norm(V.tanh_map(v)), "mapped"), _r(V.norm(V.inverse_tanh_map(v)), "lifted"), _r(V.norm(V.radial_nudge(v, F.lit(0.5), 0.3)), "nudged"))


@query(f"{EMB} SELECT idx, round(vec[1] * pow(1 - norm * norm, 2) / 4, 6) AS g1, round(sqrt(norm * norm) * pow(1 - norm * norm, 2) / 4, 6) AS g FROM norms")
def riemannian_gradient(spark, sf_dir):
    g = V.riemannian_gradient(F.col("vec"), F.col("vec"))
    return scaled_vectors(spark, sf_dir).select("idx", _r(F.get(g, F.lit(0)), "g1"), _r(V.norm(g), "g"))


@query(f"{TWO} SELECT idx, round(acosh(greatest(sqrt(1 + {_NU}) * sqrt(1 + {_NV}) - {_UV}, 1)), 6) AS lorentz, round(sqrt({_NU}) / (sqrt(1 + {_NU}) + 1), 6) AS ball_norm FROM two")
def lorentz_geometry(spark, sf_dir):
    x, y = V.lorentz_lift(F.col("u")), V.lorentz_lift(F.col("v"))
    return _two(spark, sf_dir).select("idx", _r(V.lorentz_distance(x, y), "lorentz"), _r(V.norm(V.lorentz_to_poincare(x)), "ball_norm"))


_R0 = "(0.2 / (1 + sqrt(1.04)))"
_ANGLE = f"acos(least(greatest(({_UV} * (1 + {_NU}) - {_NU} * (1 + {_NV})) / (sqrt({_NU}) * sqrt({_SQ}) * sqrt(greatest(1 + {_NU} * {_NV} - 2 * {_UV}, 1e-15))), -1 + 1e-5), 1 - 1e-5))"
_APERTURE = f"asin(least(greatest({_R0} * (1 - {_NU}) / sqrt({_NU}), -1 + 1e-5), 1 - 1e-5))"


@query(f"{TWO} SELECT idx, round({_APERTURE}, 6) AS aperture, round({_ANGLE}, 6) AS angle, round(greatest({_ANGLE} - {_APERTURE}, 0), 6) AS energy FROM two")
def entailment_cones(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    return _two(spark, sf_dir).select("idx", _r(V.cone_aperture(u), "aperture"), _r(V.cone_angle(u, v), "angle"), _r(V.cone_energy(u, v), "energy"))


@query(f"{TWO} SELECT idx, round(sqrt({_SQ}), 6) AS euclid, round({_SQ}, 6) AS squared FROM two")
def euclidean_distance(spark, sf_dir):
    d = V.squared_distance(F.col("u"), F.col("v"))
    return _two(spark, sf_dir).select("idx", _r(F.sqrt(d), "euclid"), _r(d, "squared"))


@query(f"{PAIRED} SELECT descendant_idx, ancestor_idx, round(0.05 + 0.95 * depth_diff / (SELECT max(depth_diff) FROM pairs), 6) AS margin, round(sqrt(depth_diff + 1) / (SELECT avg(sqrt(depth_diff + 1)) FROM pairs), 6) AS weight FROM pairs")
def pair_margin(spark, sf_dir):
    pairs = _geo_pairs(spark, sf_dir)[3]
    one = F.broadcast(pairs.agg(F.max("depth_diff").alias("deepest"), F.avg(F.sqrt(F.col("depth_diff") + 1)).alias("mean")))
    return pairs.join(one, F.lit(True)).select("descendant_idx", "ancestor_idx", _r(V.depth_margin(F.col("depth_diff"), F.col("deepest")), "margin"), _r(F.sqrt(F.col("depth_diff") + 1) / F.col("mean"), "weight"))


# ---------------------------------------------------------------- metrics


@query(f"{EMB} SELECT count(*) AS n, round(min(norm), 6) AS least, round(avg(norm), 6) AS mean, round(max(norm), 6) AS most, count(*) FILTER (norm >= 1) AS outside, count(*) FILTER (norm > 0.9) AS above_90 FROM norms")
def norm_stats(spark, sf_dir):
    s = M.norm_stats(scaled_vectors(spark, sf_dir))
    return s.select("n", *[_r(F.col(c), c) for c in ("least", "mean", "most")], "outside", "above_90")


@query(f"{EMB}, p(p) AS (VALUES (0.0), (0.1), (0.25), (0.5), (0.75), (0.9), (0.99), (1.0)), q AS (SELECT quantile_cont(norm, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]) AS q FROM norms) SELECT CAST([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0][i] AS DOUBLE) AS p, round(q[i], 6) AS value FROM q, range(1, 9) t(i)")
def norm_percentiles(spark, sf_dir):
    return M.norm_percentiles(scaled_vectors(spark, sf_dir)).select("p", _r(F.col("value"), "value"))


@query(f"{EMB}, x AS (SELECT unnest(vec) AS x, unnest(range(64)) AS dim FROM emb) SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM x GROUP BY dim")
def dimension_variances(spark, sf_dir):
    return M.dimension_variances(scaled_vectors(spark, sf_dir)).select("dim", _r(F.col("mean"), "mean"), _r(F.col("variance"), "variance"))


@query(f"{EMB} SELECT idx % 3 = 0 AS trained, count(*) AS n, round(avg(norm), 6) AS mean_norm, round(max(norm), 6) AS max_norm FROM norms GROUP BY 1")
def trained_summary(spark, sf_dir):
    e = scaled_vectors(spark, sf_dir)
    return M.trained_summary(e, e.where("idx % 3 = 0")).select("trained", "n", _r(F.col("mean_norm"), "mean_norm"), _r(F.col("max_norm"), "max_norm"))


@query(f"{EMB}, m AS (SELECT avg(norm) AS a, avg(norm * 0.7 + 0.15) AS b, min(norm) AS c, min(norm * 0.7 + 0.15) AS d, max(norm) AS e, max(norm * 0.7 + 0.15) AS f FROM norms) SELECT metric, round(x, 6) AS before, round(y, 6) AS after, round(y - x, 6) AS delta FROM (SELECT 'mean' AS metric, a AS x, b AS y FROM m UNION ALL SELECT 'least', c, d FROM m UNION ALL SELECT 'most', e, f FROM m)")
def checkpoint_comparison(spark, sf_dir):
    e = scaled_vectors(spark, sf_dir)
    after = e.withColumn("vec", V.radial_nudge(F.col("vec"), F.lit(0.5), 0.3))
    return M.compare_vectors(e, after).where("metric in ('least', 'mean', 'most')").select("metric", *[_r(F.col(c), c) for c in ("before", "after", "delta")])


@query(f"{PAIRED}, p AS (SELECT ancestor_idx AS idx, ancestor_depth AS depth FROM pairs WHERE depth_diff = 3 UNION SELECT descendant_idx, descendant_depth FROM pairs WHERE depth_diff = 3) SELECT m.idx, CAST(coalesce(p.depth, CASE WHEN m.taxid % 2 = 0 THEN d.depth END, 4) AS INTEGER) AS depth, CASE WHEN p.depth IS NOT NULL THEN 'pairs' WHEN m.taxid % 2 = 0 THEN 'tree' ELSE 'default' END AS origin FROM mapping m LEFT JOIN p ON p.idx = m.idx LEFT JOIN depths d ON d.taxid = m.taxid")
def depth_backfill(spark, sf_dir):
    _, paths, mapping, pairs = _geo_pairs(spark, sf_dir)
    return M.backfilled_depths(mapping, P.depth_of_indices(pairs.where("depth_diff = 3")), paths.where("taxid % 2 = 0"), 4)


_CAP = f"md5('1|' || CAST(idx AS VARCHAR))"
GROUP_PAIRS = f"""WITH {VECTORS_SQL}, g AS (SELECT class, row_number() OVER (ORDER BY class) AS g FROM emb GROUP BY class HAVING count(*) >= 10),
s AS (SELECT g, idx, vec, row_number() OVER (PARTITION BY g ORDER BY idx) AS i FROM (SELECT g, idx, vec, row_number() OVER (PARTITION BY g ORDER BY {_CAP}, idx) AS r FROM emb JOIN g USING (class)) WHERE r <= 100),
two AS (SELECT true AS same, a.vec AS u, b.vec AS v FROM s a JOIN s b ON a.g = b.g AND b.i > a.i AND b.i < a.i + 20 UNION ALL SELECT false, a.vec, b.vec FROM s a JOIN s b ON a.i = 1 AND b.i = 1 AND b.g > a.g AND b.g < a.g + 10),
d AS (SELECT same, acosh(1 + 2 * {_SQ} / ((1 - {_HU}) * (1 - {_HV}) + 1e-5) + 1e-5) AS d FROM two)"""


def _group_pairs(spark, sf_dir):
    return M.group_pairs(scaled_vectors(spark, sf_dir), "class")


@query(f"{GROUP_PAIRS} SELECT count(*) FILTER (same) AS n_intra, count(*) FILTER (NOT same) AS n_inter, round(avg(d) FILTER (same), 6) AS mean_intra, round(avg(d) FILTER (NOT same), 6) AS mean_inter, round(stddev_pop(d) FILTER (same), 6) AS std_intra, round(stddev_pop(d) FILTER (NOT same), 6) AS std_inter, round(avg(d) FILTER (NOT same) / avg(d) FILTER (same), 6) AS ratio FROM d")
def group_distances(spark, sf_dir):
    return M.group_distances(_group_pairs(spark, sf_dir)).select("n_intra", "n_inter", *[_r(F.col(c), c) for c in ("mean_intra", "mean_inter", "std_intra", "std_inter", "ratio")])


@query(f"{GROUP_PAIRS}, m AS (SELECT median(d) AS m FROM d WHERE NOT same) SELECT round(max(m), 6) AS median, round(100 * avg(CASE WHEN d > m THEN 1.0 ELSE 0.0 END), 6) AS overlap_pct FROM d, m WHERE same")
def distance_overlap(spark, sf_dir):
    return M.overlap_share(_group_pairs(spark, sf_dir)).select(_r(F.col("median"), "median"), _r(F.col("overlap_pct"), "overlap_pct"))


@query(f"{EMB} SELECT count(*) AS n, round(corr(depth, norm), 6) AS pearson, round(regr_slope(norm, depth), 6) AS slope, round(regr_intercept(norm, depth), 6) AS intercept FROM norms")
def depth_norm_corr(spark, sf_dir):
    c = M.depth_norm_correlation(M.norms(scaled_vectors(spark, sf_dir)).select("depth", "norm"))
    return c.select("n", *[_r(F.col(x), x) for x in ("pearson", "slope", "intercept")])


@query("WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part) SELECT round(corr(a, b), 6) AS spearman FROM r")
def spearman(spark, sf_dir):
    return M.spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").select(_r(F.col("spearman"), "spearman"))


@query(f"{EMB} SELECT depth, count(*) AS n, round(min(norm), 6) AS least, round(quantile_cont(norm, 0.25), 6) AS q1, round(quantile_cont(norm, 0.5), 6) AS median, round(quantile_cont(norm, 0.75), 6) AS q3, round(max(norm), 6) AS most FROM norms GROUP BY depth")
def norm_by_depth(spark, sf_dir):
    q = M.norm_by_depth(M.norms(scaled_vectors(spark, sf_dir)))
    return q.select("depth", "n", *[_r(F.col(c), c) for c in ("least", "q1", "median", "q3", "most")])


@query(f"{EMB}, p AS (SELECT x.norm AS a, y.norm AS d FROM norms x JOIN norms y ON y.class = x.class + 1) SELECT count(*) AS n, round(100 * avg(CASE WHEN round(a, 9) < round(d, 9) THEN 1.0 ELSE 0.0 END), 6) AS hierarchy_pct FROM p")
def hierarchy_pct(spark, sf_dir):
    e = scaled_vectors(spark, sf_dir).withColumn("vec", F.transform("vec", lambda x: F.round(x, 9)))
    n = M.norms(e)
    return M.hierarchy_share_of_groups(n.select((F.col("class") + 1).alias("c"), "norm"), n.select(F.col("class").alias("c"), "norm"), "c").select("n", _r(F.col("hierarchy_pct"), "hierarchy_pct"))


_DIST = f"acosh(greatest(1 + 2 * {_SQ} / ((1 - {_HU}) * (1 - {_HV}) + 1e-5), 1 + 1e-5))"
ALL_PAIRS = f"{EMB}, d AS (SELECT i, j, ci, cj, {_DIST} AS d FROM (SELECT x.idx AS i, y.idx AS j, x.class AS ci, y.class AS cj, x.vec AS u, y.vec AS v FROM emb x JOIN emb y ON x.idx <> y.idx))"
NEAR = f"{ALL_PAIRS}, near AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM d QUALIFY rank <= 10)"


@query(f"{NEAR} SELECT i AS idx, CAST(rank AS INTEGER) AS rank, j AS neighbor, round(d, 6) AS distance FROM near")
def nearest_neighbors(spark, sf_dir):
    return M.nearest_neighbors(scaled_vectors(spark, sf_dir), 10, "class").select("idx", "rank", "neighbor", _r(F.col("distance"), "distance"))


@query(f"{NEAR} SELECT count(*) AS n, round(avg(CASE WHEN ci = cj THEN 1.0 ELSE 0.0 END), 6) AS purity FROM near")
def knn_purity(spark, sf_dir):
    return M.knn_purity(scaled_vectors(spark, sf_dir), "class").select("n", _r(F.col("purity"), "purity"))


@query(f"{NEAR} SELECT 'class' AS scale, count(*) AS n, round(avg(CASE WHEN ci = cj THEN 1.0 ELSE 0.0 END), 6) AS purity FROM near UNION ALL SELECT 'depth', count(*), round(avg(CASE WHEN ci % 5 = cj % 5 THEN 1.0 ELSE 0.0 END), 6) FROM near UNION ALL SELECT 'half', count(*), round(avg(CASE WHEN ci // 5 = cj // 5 THEN 1.0 ELSE 0.0 END), 6) FROM near")
def multiscale_knn(spark, sf_dir):
    near = M.nearest_neighbors(scaled_vectors(spark, sf_dir), 10, "class")
    same = lambda f: F.avg((f(F.col("cls")) == f(F.col("neighbor_cls"))).cast("double"))
    one = near.agg(F.count("*").alias("n"), same(lambda c: c).alias("class"), same(lambda c: c % 5).alias("depth"), same(lambda c: F.floor(c / 5)).alias("half"))
    return one.select("n", F.explode(F.create_map(F.lit("class"), "class", F.lit("depth"), "depth", F.lit("half"), "half")).alias("scale", "purity")).select("scale", "n", _r(F.col("purity"), "purity"))


@query(f"{ALL_PAIRS} SELECT count(*) FILTER (ci = cj) AS n_intra, count(*) FILTER (ci <> cj) AS n_inter, round(avg(d) FILTER (ci = cj), 6) AS mean_intra, round(avg(d) FILTER (ci <> cj), 6) AS mean_inter, round(stddev_pop(d) FILTER (ci = cj), 5) AS std_intra, round(stddev_pop(d) FILTER (ci <> cj), 5) AS std_inter, round(avg(d) FILTER (ci <> cj) / (avg(d) FILTER (ci = cj) + 1e-8), 6) AS ratio FROM d")
def class_separation(spark, sf_dir):
    s = M.class_separation(scaled_vectors(spark, sf_dir), "class")
    return s.select("n_intra", "n_inter", *[_r(F.col(c), c) for c in ("mean_intra", "mean_inter")], *[F.round(c, 5).alias(c) for c in ("std_intra", "std_inter")], _r(F.col("ratio"), "ratio"))


@query(f"{ALL_PAIRS} SELECT ci = cj AS same, CAST(least(floor(d / 0.25), 63) AS INTEGER) AS bin, count(*) AS n FROM d GROUP BY 1, 2")
def distance_histogram(spark, sf_dir):
    return M.distance_histogram(scaled_vectors(spark, sf_dir), "class")


@query(f"{ALL_PAIRS}, h AS (SELECT i, d, j, ci = cj AS hit FROM d), o AS (SELECT i, hit, row_number() OVER (PARTITION BY i ORDER BY d, j) AS place, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY i ORDER BY d, j) AS found FROM h) SELECT i AS source, count(*) AS n, round(avg(place - found + 1), 6) AS mean_rank, round(avg(found / place), 6) AS ap FROM o WHERE hit GROUP BY i")
def reconstruction_map(spark, sf_dir):
    """Every vector is a source, and linked to all others of its class."""
    return M.reconstruction_of_classes(scaled_vectors(spark, sf_dir), "class").select("source", "n", _r(F.col("mean_rank"), "mean_rank"), _r(F.col("ap"), "ap"))


_NEXT = "h AS (SELECT e.idx AS i, (e.idx + k.k) % (SELECT max(idx) + 1 FROM emb) AS j FROM emb e, (VALUES (1), (2), (40)) k(k))"


@query(f"{ALL_PAIRS}, {_NEXT}, t AS (SELECT h.i, h.j, d.d FROM h JOIN d ON d.i = h.i AND d.j = h.j), p AS (SELECT t.i, t.j, 1 + count(*) FILTER (o.d < t.d OR o.d = t.d AND o.j < t.j) AS place FROM t JOIN d o ON o.i = t.i GROUP BY t.i, t.j), f AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY place, j) AS found FROM p) SELECT i AS source, count(*) AS n, round(avg(place - found + 1), 6) AS mean_rank, round(avg(found / place), 6) AS ap FROM f GROUP BY i")
def reconstruction_of_links(spark, sf_dir):
    """Three links of each vector, as many as grow with the vectors: to the next, the next but one and the fortieth."""
    e = scaled_vectors(spark, sf_dir)
    n = F.broadcast(e.agg((F.max("idx") + 1).alias("n")))
    links = e.join(n, F.lit(True)).select(F.col("idx").alias("source"), F.explode(F.array(*[F.pmod(F.col("idx") + k, F.col("n")) for k in (1, 2, 40)])).alias("target"))
    return M.reconstruction(links, e).select("source", "n", _r(F.col("mean_rank"), "mean_rank"), _r(F.col("ap"), "ap"))


@query(f"{EMB}, x AS (SELECT idx, unnest(vec) AS v, unnest(range(64)) AS k FROM emb), c AS (SELECT a.k AS i, b.k AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b ON a.idx = b.idx GROUP BY a.k, b.k) SELECT (SELECT count(*) FROM emb) AS n, round(pow(sum(CASE WHEN i = j THEN c END), 2) / sum(c * c), 6) AS participation_ratio FROM c")
def participation_ratio(spark, sf_dir):
    return M.participation_ratio(scaled_vectors(spark, sf_dir)).select("n", _r(F.col("participation_ratio"), "participation_ratio"))


@query(f"{GEO}, c AS (SELECT a AS class, count(*) + 1 AS n FROM down JOIN depths x ON x.taxid = a WHERE x.depth = 1 GROUP BY a) SELECT class, n, round(least(sqrt((SELECT max(n) FROM c) / n), 10), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return M.class_weights(T.class_labels(_geo_paths(spark, sf_dir)[1])).select("class", "n", _r(F.col("weight"), "weight"))


@query(f"{GEO} SELECT count(*) AS n, CAST(ceil(2 * ln(count(*)) / 0.09) AS INTEGER) AS packing, CAST(least(greatest(ceil(2 * ln(count(*)) / 0.09), 10), 200) AS INTEGER) AS recommended FROM nodes")
def recommend_dim(spark, sf_dir):
    p = M.packing_dimension_column(F.col("n"))
    return geo(spark, sf_dir).agg(F.count("*").alias("n")).select("n", p.alias("packing"), F.least(F.greatest(p, F.lit(10)), F.lit(200)).alias("recommended"))


@query("WITH h AS (SELECT CAST(l_linenumber AS INTEGER) AS epoch, avg(l_discount) AS loss FROM lineitem GROUP BY 1) SELECT epoch, round(loss, 6) AS loss, round(loss - lag(loss) OVER w, 6) AS delta, round(100 * (loss - lag(loss) OVER w) / lag(loss) OVER w, 5) AS delta_pct, round(min(loss) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING), 6) AS best, arg_min(epoch, loss) OVER (ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS best_epoch FROM h WINDOW w AS (ORDER BY epoch)")
def history_improvement(spark, sf_dir):
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("int").alias("epoch")).agg(F.avg("l_discount").alias("loss"))
    return M.improvement(h).select("epoch", *[_r(F.col(c), c) for c in ("loss", "delta")], F.round("delta_pct", 5).alias("delta_pct"), _r(F.col("best"), "best"), "best_epoch")


# ---------------------------------------------------------------- samples

_T = lambda seed, *k: f"md5('{seed}|' || " + " || '|' || ".join(f"CAST({x} AS VARCHAR)" for x in k) + ")"
_DRAW = lambda seed, n, *k: f"CAST('0x' || substr({_T(seed, *k)}, 1, 12) AS BIGINT) % ({n})"
_KEYS = ["ancestor_idx", "descendant_idx"]


@query(f"{PAIRED}, q AS (SELECT depth_diff, greatest(1, CAST(floor(5000.0 * count(*) / (SELECT count(*) FROM pairs) + 1e-9) AS BIGINT)) AS quota FROM pairs GROUP BY 1), r AS (SELECT p.*, {_T(11, *_KEYS)} AS t, row_number() OVER (PARTITION BY depth_diff ORDER BY {_T(11, *_KEYS)}, ancestor_idx, descendant_idx) AS rn FROM pairs p), s AS (SELECT r.*, row_number() OVER (ORDER BY CASE WHEN rn > quota THEN 1 ELSE 0 END, t, ancestor_idx, descendant_idx) AS k FROM r JOIN q USING (depth_diff)) SELECT ancestor_idx, descendant_idx, depth_diff FROM s WHERE k <= 5000")
def stratified_subsample(spark, sf_dir):
    return S.stratified_subsample(_geo_pairs(spark, sf_dir)[3], "depth_diff", 5000, 11, _KEYS).select(*_KEYS, "depth_diff")


@query(f"{PAIRED}, q AS (SELECT depth_diff, greatest(1, CAST(floor(count(*) * 0.3 + 1e-9) AS BIGINT)) AS quota FROM pairs GROUP BY 1), r AS (SELECT p.*, row_number() OVER (PARTITION BY depth_diff ORDER BY {_T(12, *_KEYS)}, ancestor_idx, descendant_idx) AS rn FROM pairs p) SELECT ancestor_idx, descendant_idx, depth_diff FROM r JOIN q USING (depth_diff) WHERE rn <= quota")
def epoch_fraction(spark, sf_dir):
    return S.fraction_sample(_geo_pairs(spark, sf_dir)[3], "depth_diff", 0.3, 12, _KEYS).select(*_KEYS, "depth_diff")


LABELED = f"{GEO}, lab AS (SELECT d AS taxid, a AS class FROM down JOIN depths x ON x.taxid = a WHERE x.depth = 1 UNION ALL SELECT taxid, taxid FROM depths WHERE depth = 1)"


@query(f"{LABELED}, n AS (SELECT class, count(*) AS n, greatest(1, 20000 // (SELECT count(DISTINCT class) FROM lab)) AS quota FROM lab GROUP BY class), w AS (SELECT class, n, quota, unnest(range(1, quota + 1)) AS draw_no FROM n), p AS (SELECT class, draw_no, CASE WHEN n >= quota THEN draw_no ELSE {_DRAW(13, 'n', 'class', 'draw_no')} + 1 END AS place FROM w), r AS (SELECT taxid, class, row_number() OVER (PARTITION BY class ORDER BY {_T(13, 'taxid')}, taxid) AS rn FROM lab) SELECT r.taxid, r.class, CAST(draw_no AS INTEGER) AS draw_no FROM p JOIN r ON r.class = p.class AND r.rn = p.place")
def class_balanced(spark, sf_dir):
    return S.class_balanced(T.class_labels(_geo_paths(spark, sf_dir)[1]), "class", 20_000, 13, ["taxid"]).select("taxid", "class", "draw_no")


@query(f"{LABELED} SELECT taxid, class FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY {_T(14, 'taxid')}, taxid) AS rn FROM lab) WHERE rn <= 100")
def group_cap(spark, sf_dir):
    return S.capped_sample(T.class_labels(_geo_paths(spark, sf_dir)[1]), ["class"], 100, 14, ["taxid"])


@query(f"{GEO} SELECT taxid FROM nodes ORDER BY {_T(15, 'taxid')}, taxid LIMIT 500")
def simple_sample(spark, sf_dir):
    return S.simple_sample(geo(spark, sf_dir).select("taxid"), 500, 15, ["taxid"])


@query(f"{GEO} SELECT taxid, CAST((row_number() OVER (ORDER BY {_T(16, 'taxid')}, taxid) - 1) // 64 AS INTEGER) AS batch FROM nodes")
def hash_batches(spark, sf_dir):
    return S.batches(geo(spark, sf_dir).select("taxid"), 64, 16, ["taxid"])


def _drawable(spark, sf_dir):
    nodes, paths = _geo_paths(spark, sf_dir)
    return paths.join(P.dense_mapping(nodes), "taxid").select("idx", "depth", F.get("path", F.col("depth") - 2).alias("gp"), F.get("path", F.lit(1)).alias("class"))


NEG = f"{MAPPED}, x AS (SELECT m.idx, CAST(p.depth AS INTEGER) AS depth, g.a AS gp, CASE WHEN p.depth = 1 THEN m.taxid ELSE c.a END AS class FROM mapping m JOIN depths p ON p.taxid = m.taxid LEFT JOIN down g ON g.d = m.taxid AND g.dd = 2 LEFT JOIN (SELECT d, a FROM down JOIN depths y ON y.taxid = a WHERE y.depth = 1) c ON c.d = m.taxid)"


def _tiers_sql(tiers, k, seed):
    """Draws tier by tier, with the fallbacks, in SQL."""
    parts, found, low = [f"want AS (SELECT x.*, unnest(range(1, {k + 1})) AS draw_no FROM x)"], [], 0

    def hit(name, label, by, seed, source, cond):
        on = " AND ".join(f"p.{c} = w.{c}" for c in by)
        return f"""p_{name} AS (SELECT idx, {', '.join(by)}, row_number() OVER (PARTITION BY {', '.join(by)} ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY {', '.join(by)}) AS size FROM x WHERE {' AND '.join(f'{c} IS NOT NULL' for c in by)}),
s_{name} AS (SELECT DISTINCT {', '.join(by)}, size FROM p_{name}),
d_{name} AS MATERIALIZED (SELECT w.idx, w.draw_no, {', '.join('w.' + c for c in by)}, {_DRAW(seed, 's.size', f"'{label}'", 'w.idx', 'w.draw_no')} AS pos FROM {source} w JOIN s_{name} s ON {on.replace('p.', 's.')} WHERE {cond}),
h_{name} AS MATERIALIZED (SELECT w.idx AS descendant_idx, w.draw_no, p.idx AS negative_idx, '{label}' AS tier FROM d_{name} w JOIN p_{name} p ON {on} AND p.pos = w.pos WHERE p.idx <> w.idx)"""

    for name, by, high in tiers:
        parts.append(hit(name, name, by, seed, "want", f"w.draw_no > {low} AND w.draw_no <= {high}"))
        found.append(f"SELECT * FROM h_{name}")
        low = high
    name, by, _ = tiers[-1]
    parts.append(f"f1 AS ({' UNION ALL '.join(found)}), left1 AS (SELECT w.* FROM want w LEFT JOIN f1 ON f1.descendant_idx = w.idx AND f1.draw_no = w.draw_no WHERE f1.draw_no IS NULL)")
    parts.append(hit("again", name, by, seed + 1, "left1", "true"))
    parts.append("f2 AS (SELECT * FROM f1 UNION ALL SELECT * FROM h_again), left2 AS (SELECT w.* FROM want w LEFT JOIN f2 ON f2.descendant_idx = w.idx AND f2.draw_no = w.draw_no WHERE f2.draw_no IS NULL), nn AS (SELECT count(*) AS n FROM x)")
    step = _DRAW(seed, "n - 1", "'random'", "idx", "draw_no")
    return ", ".join(parts) + f" SELECT descendant_idx, CAST(draw_no AS INTEGER) AS draw_no, CAST(negative_idx AS INTEGER) AS negative_idx, tier FROM f2 UNION ALL SELECT idx, CAST(draw_no AS INTEGER), CAST((idx + 1 + {step}) % n AS INTEGER), 'random' FROM left2, nn"


SAME_DEPTH = [("depth", ["depth"], 5)]
TIERED = [("grandparent", ["gp", "depth"], 5), ("class", ["class", "depth"], 8), ("depth", ["depth"], 10)]


@query(f"{NEG}, {_tiers_sql(SAME_DEPTH, 5, 17)}")
def negatives_same_depth(spark, sf_dir):
    return S.negatives(_drawable(spark, sf_dir), 5, 17, SAME_DEPTH)


@query(f"{NEG}, {_tiers_sql(TIERED, 10, 18)}")
def negatives_tiered(spark, sf_dir):
    return S.negatives(_drawable(spark, sf_dir), 10, 18, TIERED)


@query(f"WITH w AS (SELECT o_custkey AS id, pow(count(*), 0.75) AS weight FROM orders GROUP BY o_custkey), c AS (SELECT id, sum(weight) OVER (ORDER BY id) AS high, weight FROM w), t AS (SELECT sum(weight) AS total FROM w), d AS (SELECT draw_no, {_DRAW(19, 1 << 40, 'draw_no')} / {float(1 << 40)} * total AS point FROM range(1, 10001) r(draw_no), t) SELECT draw_no, id FROM d ASOF JOIN (SELECT id, high - weight AS low FROM c) c ON d.point >= c.low")
def weighted_negatives(spark, sf_dir):
    cooc = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id1"), F.col("o_custkey").alias("id2"), F.lit(1.0).alias("weight"))
    return S.weighted_draws(P.unigram_weights(cooc), 10_000, 19)
