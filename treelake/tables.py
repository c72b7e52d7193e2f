"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows above which a key counts as hot: these rows meet the key's one row by broadcast.
MANY = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. A temporary one stands in only where all executors are this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="treelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared one, as a whole address; it goes when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/treelake/{name}-{uuid.uuid4().hex[:12]}")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    whole = store.makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, order: list[str], out: str, kind: str = "int") -> DataFrame:
    """Adds `out`: 0, 1, 2, ... in the order of the columns `order`, without one task for all rows.

    Rows are range-partitioned, sorted and numbered in the task that holds their range, so they are shuffled once; the
    counts of the ranges (one row each) give the offsets.
    """
    # the id of a row: its task's number, and below 33 bits its place there
    part = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_own", F.monotonically_increasing_id()), "ranges")
    part = part.withColumn("_part", F.shiftright("_own", 33)).withColumn("_own", F.col("_own").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = part.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_base")))
    return part.join(offsets, "_part").withColumn(out, (F.col("_base") + F.col("_own")).cast(kind)).drop("_part", "_own", "_base")


def running_total(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows up to and with this one in the order of `order`, without one task for all rows.

    As in `dense_index`, a range is summed in the task that holds it; the sums of the ranges (one row each) give the offsets.
    """
    rows = df.withColumn("_value", F.coalesce(value, F.lit(0)))
    kind = StructType([*rows.schema.fields, StructField("_own", rows.schema["_value"].dataType)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last = 0
        for b in batches:
            v = b.column("_value").to_numpy()
            own = np.cumsum(np.concatenate([np.array([last], v.dtype), v]))[1:]
            last = own[-1] if len(own) else last
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own)], [*b.schema.names, "_own"])

    summed = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kind)
    part = saved(summed.withColumn("_part", F.spark_partition_id()), "ranges")
    sums = part.groupBy("_part").agg(F.sum("_value").alias("_n"))  # one row a range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = F.broadcast(sums.select("_part", before.alias("_base")))
    return part.join(offsets, "_part").withColumn(out, F.coalesce("_base", F.lit(0)) + F.col("_own")).drop("_part", "_own", "_base", "_value")


def with_group(rows: DataFrame, groups: DataFrame, by: list[str], size: str, how: str = "inner", most: int = MANY) -> DataFrame:
    """rows with the columns of their group, for groups(<by>, <size>, ...) of one row a group, `size` being how many rows it has.

    Groups above `most` rows are broadcast, of which there are no more than rows / most, so none meets its rows in one task.
    Groups with a null in `by` match nothing.
    """
    big = F.broadcast(groups.where(F.col(size) > most))
    rest = rows.join(big.select(*by), by, "left_anti").join(groups.where(F.col(size) <= most), by, how)
    return rows.join(big, by).unionByName(rest)


def met(rows: DataFrame, other: DataFrame, key: str, most: int = MANY) -> DataFrame:
    """rows with the columns of other(<key>, ...), which has one row a key; rows without one are left out.

    Keys that more than `most` rows share meet them by broadcast, of which there are no more than rows / most; the rest by a join.
    """
    hot = saved(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(key), "hot")
    far = rows.join(F.broadcast(other.join(F.broadcast(hot), key, "left_semi")), key)
    return far.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(other, key))
