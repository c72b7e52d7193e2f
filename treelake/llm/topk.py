"""Exact top-k search: tiled matrix products, partial selection per tile, tree merging of the lists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, store_of


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x) of each component. Null or non-finite ones take the whole row out."""
    x = F.col(vector_col).cast("array<double>")
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    # from 2^52 on every double is whole, and floor() to a long would overflow for huge ones
    whole = lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)
    return vectors.where(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: whole(c * scale)).alias("v"))


def _by_length(batch) -> Iterator[tuple]:
    """(ids, matrix) of the vectors of each length in an Arrow batch of (vec_id, v)."""
    import numpy as np
    import pyarrow.compute as pc

    length = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
    for dim in np.unique(length):
        part = batch if (length == dim).all() else batch.filter(length == dim)
        yield part.column("vec_id").to_numpy(), part.column("v").flatten().to_numpy().reshape(-1, dim)


def _blocks(queries: DataFrame, size: int) -> DataFrame:
    """(block long, dim int, ids binary, matrix binary): at most `size` queries of one length in a row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            for ids, m in _by_length(b):
                for at in range(0, len(ids), size):
                    n += 1
                    row = [[(part << 32) + n], [m.shape[1]], [ids[at : at + size].astype("<i8").tobytes()], [np.ascontiguousarray(m[at : at + size], "<f8").tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["block", "dim", "ids", "matrix"])

    return queries.mapInArrow(run, "block long, dim int, ids binary, matrix binary")


def _read_blocks(folder: str, dim: int) -> Iterator[tuple]:
    """(block, ids, matrix) of the written query blocks of one length, a row at a time."""
    import numpy as np
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    store, top = store_of(folder)
    for f in sorted(store.get_file_info(fs.FileSelector(top)), key=lambda f: f.path):
        if f.path.endswith(".parquet"):
            with store.open_input_file(f.path) as file:
                for b in pq.ParquetFile(file).iter_batches(batch_size=1):
                    r = b.to_pylist()[0]
                    if r["dim"] == dim:
                        ids = np.frombuffer(r["ids"], "<i8")
                        yield r["block"], ids, np.frombuffer(r["matrix"], "<f8").reshape(len(ids), dim)


def best_in_tile(queries, query_ids, shard, shard_ids, k: int):
    """For each query row: (slots, shard ids, scores) of its k best, ties to the smaller id; its own id left out."""
    import numpy as np

    order = np.argsort(shard_ids, kind="stable")
    shard, shard_ids = shard[order], shard_ids[order]
    lim = np.iinfo(np.int64)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(shard).max(initial=0)) * queries.shape[1]
    if bound < 2**53:
        scores = (queries @ shard.T).astype(np.int64)  # every partial sum is an integer below 2^53, so exact
    else:  # exact whole numbers; what a long can't hold saturates
        wide = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in shard], object).T
        scores = np.array([[min(max(x, lim.min + 1), lim.max) for x in r] for r in wide], np.int64)
    own = query_ids[:, None] == shard_ids[None, :]
    scores[own] = lim.min
    n = len(shard_ids)
    if n <= k:
        take = ~own
    else:
        least = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above, tie = scores > least, scores == least
        take = (above | tie & (tie.cumsum(1) <= k - above.sum(1, keepdims=True))) & ~own
    slots, at = np.nonzero(take)
    return slots, shard_ids[at], scores[slots, at]


def best_of_lists(lists: list[tuple], k: int):
    """One list from several of best_in_tile: the k best of each slot."""
    import numpy as np

    slots, ids, scores = (np.concatenate(x) for x in zip(*lists))
    order = np.lexsort((ids, -scores, slots))
    slots, ids, scores = slots[order], ids[order], scores[order]
    place = np.arange(len(slots)) - np.searchsorted(slots, slots)
    return slots[place < k], ids[place < k], scores[place < k]


def exact_top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5, tile: int = 2048, query_tile: int = 512, shard_bytes: int = 64 << 20, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k highest inner products among `vectors`.

    Both hold (vec_id, v) as from `quantize`. Ties go to the smaller vec_id. Rows with the query's own
    vec_id are left out. A query that comes in several rows gets a list for each of them; vectors that
    repeat are candidates as often. Vectors of another length than the query's are no candidates. With
    fewer than k candidates all are given; with none, the query has no row.

    Vectors never move: each task gathers shards of about `shard_bytes` of its own vectors and lets the query
    blocks, written once to the shared folder, stream past them. Each block meets the shard's tiles as dense
    products, the tiles' lists are merged at once, and only k rows a query and shard are shuffled. These
    are merged in rounds of `fan_in` shards, so no task ever holds more than fan_in * k rows of one query.
    """
    scratch = Scratch(spark, "topk")
    scratch.save(_blocks(queries, query_tile), "queries")
    folder = f"{scratch.path}/queries"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, held = TaskContext.get().partitionId() << 32, 0, {}
        names, kinds = ["block", "slot", "query_id", "shard", "vec_id", "score"], [pa.int64(), pa.int32(), *[pa.int64()] * 4]

        def meet(dim):
            nonlocal n
            n += 1
            ids, m = (np.concatenate(x) for x in zip(*held.pop(dim)))
            for block, q_ids, q in _read_blocks(folder, dim):
                slot, vec, score = best_of_lists([best_in_tile(q, q_ids, m[at : at + tile], ids[at : at + tile], k) for at in range(0, len(ids), tile)], k)
                same = np.full(len(slot), 1)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((same * block, slot, q_ids[slot], same * (part + n), vec, score), kinds)], names)

        for b in batches:
            for ids, m in _by_length(b):
                held.setdefault(m.shape[1], []).append((ids, m))
                if sum(x.nbytes for _, x in held[m.shape[1]]) >= shard_bytes:
                    yield from meet(m.shape[1])
        for dim in list(held):
            yield from meet(dim)

    lists = scratch.save(vectors.mapInArrow(run, "block long, slot int, query_id long, shard long, vec_id long, score long"), "lists")
    shards = lists.select("shard").distinct()  # one row for shard_bytes of vectors
    n = shards.count()
    lists = lists.join(shards.select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("group")), "shard").drop("shard")
    best = [F.col("score").desc(), F.col("vec_id")]
    while n > fan_in:
        n = -(-n // fan_in)
        lists = lists.withColumn("group", F.floor(F.col("group") / fan_in))
        rank = F.row_number().over(Window.partitionBy("block", "slot", "group").orderBy(*best))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    rank = F.row_number().over(Window.partitionBy("block", "slot").orderBy(*best))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
