"""Tables that an operator writes between its jobs, and small helpers that all operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import new_folder, saved

#: The characters that part words in every contract: space, and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
MAX_LONG = (1 << 63) - 1


class Scratch:
    """Parquet tables below one new folder of the shared directory.

    A table that is written and read again cuts the lineage like checkpoint(): after the loss of an
    executor, later jobs read the files instead of running the earlier jobs anew. The folder goes when the
    driver ends, large tables of an operator before that.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = new_folder(spark, name)

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of jobs that are over; those of the last job are held until another has run."""
        self.spark.range(1).collect()
        gc.collect()
        self.spark._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Let Arrow batches hold `rows` rows at most from now on: at Spark's 10,000, whole texts take tens of MB a task, in the JVM and again in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def first_by_hash(ids: DataFrame, by: str, n: int) -> DataFrame:
    """(doc_id, by): of each value of `by` the n different ids of least hash.

    A count of each value tells below which hash twice as many are to be expected; only these are
    ranked, so the work of a task doesn't grow with the table.
    """
    ids = ids.select("doc_id", by).distinct()
    counts = saved(ids.groupBy(by).agg(F.count("*").alias("_n")), "counts")  # not from rows of the driver: these take Python workers of their own
    if counts.count() <= 10_000:  # else the join deals all ids by value, which many values allow
        counts = F.broadcast(counts)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = ids.join(counts, by).withColumn("_h", place).where(F.col("_h") < F.lit(float(1 << 40)) * (2 * n + 100) / F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("_h", "doc_id"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= n).select("doc_id", by)


def store_of(address: str):
    """A filesystem and a path for a whole address, as tasks reach it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(address)


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def count_words(c: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a row without an id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def as_batch(schema: str, *columns):
    """An Arrow batch of lists, arrays or columns, typed by a schema such as "a long, b string"."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [x.split(" ") for x in schema.split(", ")]
    cast = lambda c, t: c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t)
    return pa.RecordBatch.from_arrays([cast(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


@lru_cache(1)
def _trim():
    """glibc's malloc_trim; elsewhere nothing."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Hand to the system what this process has freed. A worker takes one task after another, and allocators keep freed memory,
    so the worker of a small task would stay as large as that of the largest before it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batches: Iterator, rows: int = 1024) -> Iterator:
    """Arrow batches in pieces of a few rows, so that what a task makes of long texts stays small; what it frees goes back after each batch."""
    gc.collect()  # what the task before has left
    give_back()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        give_back()


def texts_of(batch, column: str = "text") -> Iterator[bytes | None]:
    """The UTF-8 bytes of a string column of an Arrow batch, without decoding them."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    for x in batch.column(column).cast(kind):
        yield x.as_py()
