"""Queries that write a table in an outer format, read it back and must give what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import tree as T
from ..operators import validate as C
from ..sources import readers as R
from ..sources import writers as W
from ..tables import new_folder
from .queries import GEO, MAPPED, PAIRED, _geo_pairs
from .trees import VECTORS_SQL, geo, scaled_vectors, table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _lines(df, path, *columns):
    """Columns as the lines of a dump: fields parted by tab, bar, tab."""
    df.select(F.concat(F.concat_ws("\t|\t", *[F.col(c).cast("string") for c in columns]), F.lit("\t|"))).write.text(path)


@query(f"{GEO} SELECT taxid, parent, rank FROM nodes")
def dump_of_nodes(spark, sf_dir):
    path = f"{new_folder(spark, 'nodes')}/nodes.dmp"
    dirty = spark.createDataFrame([("x", "1", "rank"), ("7", "", "rank")], "taxid string, parent string, rank string")
    nodes = geo(spark, sf_dir).select(F.col("taxid").cast("string"), F.col("parent").cast("string"), "rank")
    _lines(nodes.unionByName(dirty), path, "taxid", "parent", "rank")
    return R.nodes_dump(spark, path)


@query(f"{GEO} SELECT n.taxid, count(e.child) AS n_children, CASE WHEN n.taxid % 3 = 0 THEN least(n.name, '0 ' || n.name) ELSE n.name END AS name FROM nodes n LEFT JOIN edges e ON e.parent = n.taxid GROUP BY n.taxid, n.name")
def dump_with_names(spark, sf_dir):
    """Nodes joined to one name each, the scientific one where there is one, with the counts of their children."""
    nodes, path = geo(spark, sf_dir), new_folder(spark, "names")
    _lines(nodes, f"{path}/nodes.dmp", "taxid", "parent", "rank")
    kind = F.when(F.col("taxid") % 3 == 0, "synonym").otherwise("scientific name")
    names = nodes.select("taxid", "name", F.lit("").alias("unique_name"), kind.alias("name_class"))
    other = nodes.select("taxid", F.concat(F.lit("0 "), "name").alias("name"), F.lit("").alias("unique_name"), F.lit("common name").alias("name_class"))
    _lines(names.unionByName(other), f"{path}/names.dmp", "taxid", "name", "unique_name", "name_class")
    read = R.nodes_dump(spark, f"{path}/nodes.dmp")
    counts = T.children_counts(T.edges_of(read)).select(F.col("parent").alias("taxid"), "n_children")
    named = read.join(R.preferred_names(R.names_dump(spark, f"{path}/names.dmp")), "taxid")
    return named.join(counts, "taxid", "left").select("taxid", F.coalesce("n_children", F.lit(0)).alias("n_children"), "name")


@query(f"{GEO} SELECT taxid, name FROM nodes WHERE rank = 'nation' AND taxid % 2 = 0")
def dump_scientific_names(spark, sf_dir):
    nodes, path = geo(spark, sf_dir), f"{new_folder(spark, 'names')}/names.dmp"
    kind = F.when(F.col("taxid") % 2 == 0, "scientific name").otherwise("synonym")
    _lines(nodes.select("taxid", "name", F.lit("").alias("u"), kind.alias("k")), path, "taxid", "name", "u", "k")
    return R.scientific_names(R.names_dump(spark, path), nodes.where("rank = 'nation'"))


@query(f"{GEO} SELECT parent, child FROM edges")
def text_edge_list(spark, sf_dir):
    path = f"{new_folder(spark, 'edges')}/edges.txt"
    more = spark.createDataFrame([(5, 5)], "parent long, child long")  # a self-loop
    W.edge_list(T.edges_of(geo(spark, sf_dir)).unionByName(more), path)
    return R.edge_list(spark, path)


@query(f"{MAPPED} SELECT p.idx AS parent_idx, c.idx AS child_idx FROM edges JOIN mapping p ON p.taxid = parent JOIN mapping c ON c.taxid = child")
def text_mapped_edge_list(spark, sf_dir):
    nodes, path = geo(spark, sf_dir), f"{new_folder(spark, 'edges')}/edges.mapped.txt"
    W.edge_list(P.mapped_edges(T.edges_of(nodes), P.dense_mapping(nodes)), path)
    return R.edge_list(spark, path).select(F.col("parent").cast("int").alias("parent_idx"), F.col("child").cast("int").alias("child_idx"))


@query(f"{GEO} SELECT parent, child FROM edges")
def csv_edges(spark, sf_dir):
    path = f"{new_folder(spark, 'edges')}/edges.csv"
    W.edges_csv(T.edges_of(geo(spark, sf_dir)), path)
    return R.edges_csv(spark, path)


@query(f"{MAPPED} SELECT taxid, idx FROM mapping")
def tsv_mapping(spark, sf_dir):
    path = f"{new_folder(spark, 'mapping')}/mapping.tsv"
    W.tsv(P.dense_mapping(geo(spark, sf_dir)), path)
    return R.mapping_tsv(spark, path, strict=True)


@query(f"{MAPPED} SELECT taxid, idx FROM mapping WHERE taxid % 7 <> 0 AND idx % 5 <> 0")
def tsv_mapping_with_bad_rows(spark, sf_dir):
    path = f"{new_folder(spark, 'mapping')}/mapping.tsv"
    m = P.dense_mapping(geo(spark, sf_dir))
    W.tsv(m.select(F.when(F.col("taxid") % 7 == 0, "bad").otherwise(F.col("taxid").cast("string")).alias("taxid"), F.when(F.col("idx") % 5 == 0, "x").otherwise(F.col("idx").cast("string")).alias("idx")), path)
    return R.mapping_tsv(spark, path)


@query(f"{PAIRED} SELECT * FROM pairs WHERE depth_diff <= 2")
def parquet_pairs_of_a_phase(spark, sf_dir):
    """Only the partitions of the curriculum's depth differences are read."""
    path = f"{new_folder(spark, 'pairs')}/pairs"
    W.pairs_parquet(_geo_pairs(spark, sf_dir)[3], path)
    return R.pairs_parquet(spark, path, deepest=2)


@query(f"{GEO}, two AS (SELECT CAST(parent AS VARCHAR) AS id1, CAST(child AS VARCHAR) AS id2 FROM edges), b AS (SELECT * FROM two UNION ALL SELECT id2, id1 FROM two) SELECT id1, count(*) AS n, min(id2) AS least, 1.0 * count(*) AS weight FROM b GROUP BY id1")
def csv_adjacency(spark, sf_dir):
    path = f"{new_folder(spark, 'cooc')}/edges.csv"
    T.edges_of(geo(spark, sf_dir)).select(F.col("parent").alias("id1"), F.col("child").alias("id2"), F.lit(1.0).alias("weight")).write.option("header", True).csv(path)
    rows = R.csr(R.cooccurrence(spark, path, symmetrize=True))
    weight = F.aggregate("neighbors", F.lit(0.0), lambda s, x: s + x["weight"])
    return rows.select("id1", F.size("neighbors").cast("long").alias("n"), F.get("neighbors", F.lit(0))["id2"].alias("least"), weight.alias("weight"))


@query(f"{GEO} SELECT taxid FROM nodes WHERE rank = 'nation'")
def text_id_list(spark, sf_dir):
    path = f"{new_folder(spark, 'ids')}/ids.txt"
    W.ids(geo(spark, sf_dir).where("rank = 'nation'"), path)
    return R.id_list(spark, path)


@query(f"WITH {VECTORS_SQL} SELECT idx, len(vec) AS dim, round(list_sum(list_transform(vec, lambda x, i: x * i)), 6) AS weighted FROM emb")
def checkpoint_vectors(spark, sf_dir):
    """Every component counts, at its place."""
    path = W.checkpoint(scaled_vectors(spark, sf_dir).select("idx", "vec"), {"loss": 0.5}, new_folder(spark, "run"), 1)
    weighted = F.aggregate(F.transform("vec", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return R.vectors_parquet(spark, f"{path}/vectors").select(F.col("idx").cast("long").alias("idx"), F.size("vec").cast("long").alias("dim"), F.round(weighted, 6).alias("weighted"))


@query(f"WITH {VECTORS_SQL} SELECT count(*) AS n, round(max(norm), 6) AS most, count(*) FILTER (norm >= 1) AS outside FROM norms")
def checked_checkpoint(spark, sf_dir):
    path = W.checkpoint(scaled_vectors(spark, sf_dir).select("idx", "vec"), {"loss": 0.5}, new_folder(spark, "run"), 1)
    _, seen = R.checked_vectors(spark, f"{path}/vectors")
    return spark.createDataFrame([(seen["n"], round(seen["most"], 6), seen["outside"])], "n long, most double, outside long")


_LOSSES = "e AS (SELECT CAST(class + 1 AS INTEGER) AS epoch, round(avg(norm), 6) AS loss FROM norms WHERE class IS NOT NULL GROUP BY class)"


@query(f"WITH {VECTORS_SQL}, {_LOSSES} SELECT epoch, loss FROM e QUALIFY row_number() OVER (ORDER BY epoch DESC) <= 5")
def checkpoint_leaderboard(spark, sf_dir):
    """A checkpoint for each class of vectors, with their mean norm for a loss; the last five stay."""
    e, folder = M.norms(scaled_vectors(spark, sf_dir)), new_folder(spark, "run")
    losses = e.where("class is not null").groupBy("class").agg(F.round(F.avg("norm"), 6).alias("loss")).orderBy("class").collect()  # a row a class
    for r in losses:
        W.checkpoint(e.where(F.col("class") == r["class"]).select("idx", "vec"), {"loss": r.loss}, folder, r["class"] + 1)
    return W.leaderboard(spark, folder)


@query(f"{PAIRED}, t AS (SELECT count(*) AS n, max(depth_diff) AS deepest, avg(depth_diff) AS mean FROM pairs) SELECT n AS n_pairs, deepest, round(mean, 6) AS mean, (SELECT count(*) FROM pairs WHERE depth_diff <= 1) AS first, (SELECT count(*) FROM pairs WHERE depth_diff BETWEEN 3 AND 5) AS third FROM t")
def training_data_statistics(spark, sf_dir):
    """The record that the writing pass leaves beside the pairs, read back."""
    folder = new_folder(spark, "training")
    W.training_data(_geo_pairs(spark, sf_dir)[3], folder)
    r = R.json_record(spark, f"{folder}/statistics.json", "n_pairs long, deepest int, mean double, `bin 1` long, `bin 3-5` long")
    return r.select("n_pairs", "deepest", F.round("mean", 6).alias("mean"), F.col("bin 1").alias("first"), F.col("bin 3-5").alias("third"))


@query(f"{PAIRED} SELECT ancestor_idx, descendant_idx, depth_diff FROM pairs")
def tsv_closure(spark, sf_dir):
    folder = new_folder(spark, "closure")
    W.closure_tsv(_geo_pairs(spark, sf_dir)[3].select("ancestor_idx", "descendant_idx", "depth_diff"), folder)
    return spark.read.option("header", True).option("sep", "\t").schema("ancestor_idx int, descendant_idx int, depth_diff int").csv(f"{folder}/closure")


@query("WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS line_no FROM orders) SELECT line_no, CASE WHEN o_orderkey % 5 = 1 THEN 'not a whole number' ELSE 'not two tokens' END AS issue FROM o WHERE o_orderkey % 5 IN (1, 2)")
def issues_of_edge_files(spark, sf_dir):
    """A folder of edge lists with bad lines: the lines' numbers come from the files."""
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 1, F.concat(k, F.lit(" x"))).when(k % 5 == 2, k.cast("string")).otherwise(F.concat(k, F.lit("\t1")))
    path = f"{new_folder(spark, 'edges')}/text"
    table(spark, sf_dir, "orders").orderBy("o_orderkey").select(line.alias("value")).write.text(path)
    return C.validate_edgelist(R.numbered_lines(spark, path))


@query("WITH k AS (SELECT o_orderkey AS k, lead(o_orderkey) OVER (ORDER BY o_orderkey) AS n FROM (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey % 7 <> 3)) SELECT k AS after, n AS before, n - k - 1 AS missing FROM k WHERE n > k + 1")
def gaps_of_ids(spark, sf_dir):
    return C.id_gaps(table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 3"), "o_orderkey")


@query(f"{GEO} SELECT 'world' AS name, count(*) AS n_nodes, true AS clean FROM nodes")
def json_manifest(spark, sf_dir):
    path = f"{new_folder(spark, 'manifest')}/manifest.json"
    W.record(spark, {"name": "world", "n_nodes": geo(spark, sf_dir).count(), "clean": True}, path)
    return R.json_record(spark, path, "name string, n_nodes long, clean boolean")
