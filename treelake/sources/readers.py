"""Readers of dumps, edge lists, mappings and vectors, each with an explicit schema."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import saved

_DUMP = {"sep": "|", "header": False, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "quote": "\u0000", "mode": "PERMISSIVE"}


def _dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(**_DUMP).schema(schema).csv(path)


def nodes_dump(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, parent, rank) of a nodes dump; lines without two whole numbers are dropped."""
    raw = _dump(spark, path, "taxid string, parent string, rank string")
    return raw.select(F.col("taxid").try_cast("long").alias("taxid"), F.col("parent").try_cast("long").alias("parent"), "rank").where("taxid is not null and parent is not null")


def names_dump(spark: SparkSession, path: str) -> DataFrame:
    """(taxid, name, unique_name, name_class) of a names dump."""
    raw = _dump(spark, path, "taxid string, name string, unique_name string, name_class string")
    return raw.select(F.col("taxid").try_cast("long").alias("taxid"), "name", "unique_name", "name_class").where("taxid is not null")


def preferred_names(names: DataFrame) -> DataFrame:
    """(taxid, name): the scientific name of an id, else the alphabetically first of its names."""
    scientific = F.min(F.when(F.col("name_class") == "scientific name", F.col("name")))
    return names.groupBy("taxid").agg(F.coalesce(scientific, F.min("name")).alias("name"))


def scientific_names(names: DataFrame, ids: DataFrame) -> DataFrame:
    return names.where("name_class = 'scientific name'").join(ids.select("taxid"), "taxid", "left_semi").select("taxid", "name")


def merged_dump(spark: SparkSession, path: str) -> DataFrame:
    raw = _dump(spark, path, "old_taxid string, new_taxid string")
    return raw.select(F.col("old_taxid").try_cast("long").alias("old_taxid"), F.col("new_taxid").try_cast("long").alias("new_taxid")).where("old_taxid is not null and new_taxid is not null")


def resolve_merged(ids: DataFrame, merged: DataFrame) -> DataFrame:
    """Replaces ids that have been merged into others."""
    return ids.join(merged, ids.taxid == merged.old_taxid, "left").withColumn("taxid", F.coalesce("new_taxid", "taxid")).drop("old_taxid", "new_taxid")


def _numbers(spark: SparkSession, path: str) -> tuple[Column, DataFrame]:
    lines = spark.read.text(path)
    return F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("long")), lines


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): the lines of a text or a folder of texts, numbered from 1 over all files in order of their paths.

    Lines are numbered within the split that a task reads; counts of the splits, a row each, give the rest.
    """
    at = ["_metadata.file_path", "_metadata.file_block_start"]
    lines = saved(spark.read.text(path).select("value", *[F.col(c) for c in at], F.monotonically_increasing_id().alias("_id")), "lines")
    split = ["file_path", "file_block_start"]
    own = F.row_number().over(Window.partitionBy(*split).orderBy("_id"))
    counts = lines.groupBy(*split).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.withColumn("_own", own).join(F.broadcast(counts.select(*split, before.alias("_before"))), split).select((F.col("_before") + F.col("_own")).alias("line_no"), "value")


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of a text of two numbers a line; other lines and self-loops are dropped."""
    tokens, lines = _numbers(spark, path)
    e = lines.select(tokens.alias("t")).where((F.size("t") == 2) & F.forall("t", lambda x: x.isNotNull()))
    return e.select(F.get("t", F.lit(0)).alias("parent"), F.get("t", F.lit(1)).alias("child")).where("parent <> child")


def edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """(parent, child) of a CSV of id1 (child), id2 (parent), weight."""
    raw = spark.read.schema("id1 long, id2 long, weight double").option("header", True).csv(path)
    return raw.select(F.col("id2").alias("parent"), F.col("id1").alias("child")).where("parent <> child")


def cooccurrence(spark: SparkSession, path: str, symmetrize: bool = False) -> DataFrame:
    """(id1, id2, weight) of a CSV with that header, or of whitespace-separated pairs with weight 1."""
    tokens = F.split(F.trim("value"), r"[\s,]+")
    raw = spark.read.text(path).select(tokens.alias("t")).where("size(t) in (2, 3)")
    out = raw.select(F.get("t", F.lit(0)).alias("id1"), F.get("t", F.lit(1)).alias("id2"), F.coalesce(F.get("t", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("weight"))
    out = out.where("id1 <> '' and id2 <> '' and id1 <> 'id1'")
    return out.unionByName(out.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), "weight")) if symmetrize else out


def csr(cooc: DataFrame) -> DataFrame:
    """(id1, neighbors): sorted (id2, weight) of each id; repeated pairs add up."""
    from pyspark.sql import functions as F

    sums = cooc.groupBy("id1", "id2").agg(F.sum("weight").alias("weight"))
    return sums.groupBy("id1").agg(F.sort_array(F.collect_list(F.struct("id2", "weight"))).alias("neighbors"))


def mapping_tsv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(taxid, idx) of a TSV with or without its header. strict: a bad idx is an error; else such rows are dropped."""
    raw = spark.read.schema("taxid string, idx string").option("sep", "\t").csv(path).where("taxid <> 'taxid' or idx <> 'idx'")
    if strict:
        return raw.select(F.col("taxid").cast("long").alias("taxid"), F.col("idx").cast("int").alias("idx"))
    return raw.select(F.col("taxid").try_cast("long").alias("taxid"), F.col("idx").try_cast("int").alias("idx")).where("taxid is not null and idx is not null")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").try_cast("long").alias("taxid")).where("taxid is not null")


def pairs_parquet(spark: SparkSession, path: str, deepest: int | None = None) -> DataFrame:
    """Training pairs; with `deepest` only the partitions of depth differences up to it are read."""
    from ..operators.pairs import COLUMNS

    df = spark.read.parquet(path).select(*COLUMNS)
    return df if deepest is None else df.where(F.col("depth_diff") <= deepest)


def pairs_from_rows(spark: SparkSession, rows: list) -> DataFrame:
    from ..operators.pairs import PAIRS

    return spark.createDataFrame(rows, PAIRS)


def vectors_parquet(spark: SparkSession, path: str) -> DataFrame:
    """(idx, vec) of a checkpoint."""
    return spark.read.parquet(path).select(F.col("idx").cast("int").alias("idx"), F.col("vec").cast("array<double>").alias("vec"))


def checked_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The vectors of a checkpoint, written anew, and what was seen on the way: n, the largest norm, how many lie outside the ball.

    A warning tells of those outside. The pass that reads the vectors takes the statistics along.
    """
    seen = Observation("vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    rows = saved(vectors_parquet(spark, path).observe(seen, F.count("*").alias("n"), F.max(norm).alias("most"), F.count_if(norm >= 1).alias("outside")), "checked")
    if seen.get["outside"]:
        warnings.warn(f"{seen.get['outside']} of {seen.get['n']} vectors lie outside the ball; the largest norm is {seen.get['most']:.6g}", stacklevel=2)
    return rows, dict(seen.get)


def rank_of_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(taxid, rank) of nodes whose taxid is in ids(taxid)."""
    return nodes.join(ids.select("taxid").distinct(), "taxid", "left_semi").select("taxid", "rank")


def json_record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A manifest or a run's record: one JSON object, on one line or several."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
