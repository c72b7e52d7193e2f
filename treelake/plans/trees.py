"""Trees and vectors derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import target_radius


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(df: DataFrame, taxid, parent, rank: str, name) -> DataFrame:
    return df.select(taxid.cast("long").alias("taxid"), parent.cast("long").alias("parent"), F.lit(rank).alias("rank"), name.cast("string").alias("name"))


def geo(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """World, regions, nations, customers and their orders as one tree; the root is its own parent."""
    c = F.col
    root = spark.createDataFrame([(1, 1, "root", "WORLD")], "taxid long, parent long, rank string, name string")
    out = root.unionByName(_level(table(spark, sf_dir, "region"), c("r_regionkey") + 10, F.lit(1), "region", c("r_name")))
    out = out.unionByName(_level(table(spark, sf_dir, "nation"), c("n_nationkey") + 100, c("n_regionkey") + 10, "nation", c("n_name")))
    out = out.unionByName(_level(table(spark, sf_dir, "customer"), c("c_custkey") + 1000, c("c_nationkey") + 100, "customer", c("c_name")))
    if orders:
        out = out.unionByName(_level(table(spark, sf_dir, "orders"), c("o_orderkey") + 10_000_000, c("o_custkey") + 1000, "order", c("o_orderkey")))
    return out


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types, brands within a type and parts as one tree; brands are named like containers, some names are null."""
    p = table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit("unclassified "), c)
    key = lambda *cols: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12), 16, 10).cast("long"), F.lit(1_000_000_000_000))
    t, b = key(F.col("p_type")) + 10_000_000_000_000, key(F.col("p_type"), F.col("p_brand")) + 20_000_000_000_000
    root = spark.createDataFrame([(1, 1, "root", "PARTS")], "taxid long, parent long, rank string, name string")
    out = root.unionByName(_level(p.select("p_type").distinct(), t, F.lit(1), "type", F.col("p_type")))
    out = out.unionByName(_level(p.select("p_type", "p_brand").distinct(), b, t, "brand", name(F.col("p_brand"))))
    leaf = _level(p, F.col("p_partkey") + 1000, b, "part", F.when(F.col("p_partkey") % 97 != 0, F.col("p_name")))
    return out.unionByName(leaf.withColumn("rank", F.when(F.col("taxid") % 89 != 0, F.col("rank"))))


#: Names of parts that count as noise in these trees.
PART_NOISE = (("cold", r"\bcold\b"), ("ring", r"\bring\b"), ("blue", r"^blue\s"))


def scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(idx, vec, class, depth): the embeddings, moved from the ball's boundary to a radius by class."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    r = target_radius((F.col("label") % 5).cast("double"), F.lit(4.0))
    return e.select(F.col("vec_id").alias("idx"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * r).alias("vec"), F.col("label").alias("class"), (F.col("label") % 5).alias("depth"))


#: The same in SQL, for the oracle.
def geo_sql(orders: bool = True) -> str:
    more = "UNION ALL SELECT 10000000 + o_orderkey, 1000 + o_custkey, 'order', CAST(o_orderkey AS VARCHAR) FROM orders" if orders else ""
    return f"""nodes(taxid, parent, rank, name) AS (
  SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'root', 'WORLD'
  UNION ALL SELECT 10 + r_regionkey, 1, 'region', r_name FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, 'nation', n_name FROM nation
  UNION ALL SELECT 1000 + c_custkey, 100 + c_nationkey, 'customer', c_name FROM customer {more}),
edges AS (SELECT parent, taxid AS child FROM nodes WHERE parent <> taxid)"""


PARTS_SQL = """nodes(taxid, parent, rank, name) AS (
  SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'root', 'PARTS'
  UNION ALL SELECT DISTINCT 10000000000000 + CAST('0x' || substr(md5(p_type), 1, 12) AS BIGINT) % 1000000000000, 1, 'type', p_type FROM part
  UNION ALL SELECT DISTINCT 20000000000000 + CAST('0x' || substr(md5(p_type || '|' || p_brand), 1, 12) AS BIGINT) % 1000000000000, 10000000000000 + CAST('0x' || substr(md5(p_type), 1, 12) AS BIGINT) % 1000000000000, 'brand', 'unclassified ' || p_brand FROM part
  UNION ALL SELECT p_partkey + 1000, 20000000000000 + CAST('0x' || substr(md5(p_type || '|' || p_brand), 1, 12) AS BIGINT) % 1000000000000, CASE WHEN (p_partkey + 1000) % 89 <> 0 THEN 'part' END, CASE WHEN p_partkey % 97 <> 0 THEN p_name END FROM part),
edges AS (SELECT parent, taxid AS child FROM nodes WHERE parent <> taxid)"""

#: Closure by walking down one edge at a time: independent of the paths that the engine builds.
CLOSURE_SQL = """down(a, d, dd) AS (SELECT parent, child, 1 FROM edges UNION ALL SELECT down.a, e.child, down.dd + 1 FROM down JOIN edges e ON e.parent = down.d),
depths(taxid, depth) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT d, dd FROM down WHERE a = 1)"""

VECTORS_SQL = """emb AS (SELECT vec_id AS idx, label AS class, label % 5 AS depth, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (0.1 + 0.85 * ((label % 5) / 4.0))) AS vec FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
norms AS (SELECT *, sqrt(list_inner_product(vec, vec)) AS norm FROM emb)"""
