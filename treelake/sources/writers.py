"""Writers of datasets: edges, mappings, pairs, manifests, checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import saved


def edge_list(edges: DataFrame, path: str) -> None:
    """Two columns as `a b` lines, without header."""
    a, b = edges.columns[:2]
    edges.select(F.concat_ws(" ", a, b)).write.mode("overwrite").text(path)


def edges_csv(edges: DataFrame, path: str) -> None:
    """id1 (child), id2 (parent), weight 1."""
    edges.select(F.col("child").alias("id1"), F.col("parent").alias("id2"), F.lit(1.0).alias("weight")).write.mode("overwrite").option("header", True).csv(path)


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def _dealt(pairs: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The pairs with the number _file of the file that takes each, and how many files there are: about `rows` pairs a file, of one depth difference."""
    files = pairs.groupBy(F.col("depth_diff").alias("_d")).agg(F.ceil(F.count("*") / F.lit(rows)).alias("_files"))  # a row a difference
    before = F.sum("_files").over(Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1))
    files = saved(files.withColumn("_first", F.coalesce(before, F.lit(0))), "files")
    dealt = pairs.join(F.broadcast(files), F.col("depth_diff").eqNullSafe(F.col("_d")))
    file = F.col("_first") + F.pmod(F.xxhash64("ancestor_idx", "descendant_idx"), F.col("_files"))
    return dealt.withColumn("_file", file.cast("int")).drop("_d", "_files", "_first"), files.agg(F.sum("_files").alias("n")).first().n or 1


def _write_dealt(dealt: DataFrame, files: int, path: str) -> None:
    """A task a file, whatever else is configured: hashing (depth_diff, _file) would give some tasks several files."""
    dealt.repartitionById(files, F.col("_file")).drop("_file").write.mode("overwrite").option("compression", "zstd").partitionBy("depth_diff").parquet(path)


def pairs_parquet(pairs: DataFrame, path: str, rows: int = 1_000_000) -> None:
    """Partitioned by depth difference, so that a curriculum reads only what it trains on; one shuffle, about `rows` pairs a file and a task."""
    _write_dealt(*_dealt(pairs, rows), path)


def training_data(pairs: DataFrame, path: str, rows: int = 1_000_000) -> dict:
    """Writes the pairs, and beside them a record of what the writing pass saw: how many, in bins of depth difference, the deepest."""
    seen, d = Observation("pairs"), F.col("depth_diff")
    bins = {"1": d <= 1, "2": d == 2, "3-5": (d > 2) & (d <= 5), "6-10": (d > 5) & (d <= 10), ">10": d > 10}
    dealt, files = _dealt(pairs, rows)
    _write_dealt(dealt.observe(seen, F.count("*").alias("n_pairs"), F.max(d).alias("deepest"), F.avg(d).alias("mean"), *[F.count_if(c).alias(f"bin {k}") for k, c in bins.items()]), files, f"{path}/pairs")
    facts = dict(seen.get)
    record(pairs.sparkSession, facts, f"{path}/statistics.json")
    return facts


def closure_tsv(pairs: DataFrame, path: str) -> None:
    """All pairs as a TSV with a header, and those of parent and child as an edge list."""
    tsv(pairs, f"{path}/closure")
    edge_list(pairs.where("depth_diff = 1").select("ancestor_idx", "descendant_idx"), f"{path}/edges")


def audit(rows: DataFrame, path: str) -> None:
    """An audit of names as a CSV with a header: (taxid, name, rank, reasons, kept, ...) as they come."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table or file is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def ids(df: DataFrame, path: str) -> None:
    df.select("taxid").orderBy("taxid").select(F.col("taxid").cast("string")).write.mode("overwrite").text(path)


def record(spark: SparkSession, data: dict, path: str) -> None:
    """One JSON object."""
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def kept_checkpoint(vectors: DataFrame, metrics: dict, path: str) -> None:
    """Vectors and metrics under a name that is never deleted, such as the best epoch's."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    record(vectors.sparkSession, metrics, f"{path}/metrics")


def _epochs(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and the names of its checkpoints in order."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return fs, sorted(n for n in names if n.startswith("epoch-"))


def last_checkpoint(spark: SparkSession, folder: str) -> tuple[str, int, dict] | None:
    """(path, epoch, metrics) of the last whole checkpoint; its metrics are written after its vectors."""
    fs, names = _epochs(spark, folder)
    for name in reversed(names):
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/metrics/_SUCCESS")):
            notes = json.loads(spark.read.text(f"{folder}/{name}/metrics").first().value)
            return f"{folder}/{name}", notes["epoch"], notes
    return None


def checkpoint(vectors: DataFrame, metrics: dict, folder: str, epoch: int, keep: int = 5) -> str:
    """Vectors and metrics of an epoch below `folder`; older epochs than the last `keep` are deleted."""
    spark = vectors.sparkSession
    path = f"{folder}/epoch-{epoch:05d}"
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    record(spark, {"epoch": epoch, **metrics}, f"{path}/metrics")
    fs, names = _epochs(spark, folder)
    for name in names[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"), True)
    return path


def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, loss) of the checkpoints below a folder, best first."""
    rows = spark.read.schema("epoch int, loss double").json(f"{folder}/epoch-*/metrics")
    return rows.orderBy("loss", "epoch")
