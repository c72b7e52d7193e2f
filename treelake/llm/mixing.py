"""Mixing sources to target weights along a low-discrepancy schedule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import dense_index
from .scratch import MAX_LONG, Scratch, count_words

WEIGHTS = (5, 2, 1)
#: A range of a source's shuffled stream holds about so many rows.
RANGE = 1 << 16
#: The fractional part of the golden ratio, as a fraction of 2^63 (odd, so the sequence never repeats early).
GOLDEN = 0x4F1BBCDCBFA53E0B


def _running(rows: DataFrame, keys: list[str], part: str, order: list, amount: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `amount` over all rows of the same keys that come before, without one task for a whole key.

    `part` splits each key into ranges in order; sums by range are added up first (one row a range),
    then each range adds up its own rows.
    """
    by = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, part).agg(F.sum(amount).alias("_sum")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(part).alias("_part"), F.coalesce(F.sum("_sum").over(by.partitionBy(*keys).orderBy(part)), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(part) == F.col("_part")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    rows = rows.withColumn("_own", F.coalesce(F.sum(amount).over(own), F.lit(0)))
    return rows.join(base, cond).withColumn(out, F.col("_base") + F.col("_own")).drop("_own", "_base", "_part", *[f"_{k}" for k in keys])


def source_targets(sized: DataFrame, share: float, scratch: Scratch, most: float = 2.0) -> DataFrame:
    """(s long, source, source_size, target) of each source of sized(source, size), by code point, null last.

    `share` of all sizes is shared by weight; what exceeds `most` times a source's size is shared anew among the
    rest, until none exceeds. Each round is one row of sums of whole numbers: of what the sources that are full
    take, and of the weights of the others.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = sums.select("*", F.col("source").isNull().alias("_last"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    table = dense_index(order, ["_last", "source"], "s", "long").select("s", "source", "source_size", weight.alias("w"))
    table = scratch.save(table, "sources")
    total, unit = share * (table.agg(F.sum("source_size")).first()[0] or 0), 0.0
    full = lambda: F.lit(unit) * F.col("w") > most * F.col("source_size")
    while True:
        one = table.agg(F.coalesce(F.sum(F.when(full(), most * F.col("source_size"))), F.lit(0.0)).alias("full"), F.sum(F.when(~full(), F.col("w"))).alias("w")).first()
        if not one.w or (total - one.full) / one.w <= unit:
            break
        unit = (total - one.full) / one.w
    return table.select("s", "source", "source_size", F.when(full(), most * F.col("source_size")).otherwise(F.lit(unit) * F.col("w")).alias("target"))


def schedule(spark: SparkSession, targets: DataFrame, block: int, scratch: Scratch, chunk: int = 1 << 16) -> DataFrame:
    """(slot long, s long, rank long): which source each slot of the mix takes from, and its how-manieth block that is.

    A source needs ceil(target / block) blocks. Slot i looks up the point frac(i * golden ratio) in the
    cumulative weights, so every stretch of the mix holds the sources in proportion. Ranks beyond a
    source's need are left out; the few blocks that the sequence leaves a source short of come last.
    """
    need = targets.where("floor(target) > 0").select("s", F.ceil(F.floor("target") / block).alias("need"), F.expr(f"s div {chunk}").alias("stretch"), F.lit(0).alias("all"))
    need = scratch.save(_running(need, ["all"], "stretch", [F.col("s")], "need", "low").select("s", "need", F.col("low").cast("long").alias("low"), (F.col("low") + F.col("need")).cast("long").alias("high")), "need")
    total, sources = need.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "slot long, s long, rank long")
    # the point as an integer of 63 bits, then scaled to the number of blocks: no rounding, the same on every run
    point = F.expr(f"pmod(cast(id as decimal(18,0)) * cast('{GOLDEN}' as decimal(19,0)), cast('{1 << 63}' as decimal(19,0)))")
    at_block = F.floor(point.cast("double") / float(1 << 63) * total).cast("long")
    slots = spark.range(total).select(F.col("id").alias("slot"), (F.col("id") / chunk).cast("long").alias("chunk"), F.least(at_block, F.lit(total - 1)).alias("point"))
    # cumulative weights, cut into equal cells: a point meets the few sources whose stretch touches its cell
    width = -(-total // (4 * sources))
    cells = need.select("s", "low", "high", F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))  # at most 5 rows a source
    slots = slots.withColumn("cell", F.expr(f"point div {width}")).join(cells, "cell")
    slots = slots.where("point >= low and point < high").select("slot", "chunk", "s")
    ranked = _running(slots.withColumn("one", F.lit(1)), ["s"], "chunk", [F.col("slot")], "one", "rank").select("slot", "s", F.col("rank").cast("long").alias("rank"))
    ranked = scratch.save(ranked, "ranked")
    got = ranked.groupBy("s").agg(F.count("*").alias("got"))
    short = need.join(got, "s", "left").select("s", F.coalesce("got", F.lit(0)).alias("got"), "need").where("got < need")
    tail = dense_index(short.select("s", F.explode(F.sequence("got", F.col("need") - 1)).alias("rank")), ["rank", "s"], "_at", "long")
    kept = ranked.join(need.select("s", "need"), "s").where("rank < need").select("slot", "s", "rank")
    return kept.unionByName(tail.select((F.lit(total) + F.col("_at")).alias("slot"), "s", "rank"))


def mix(spark: SparkSession, docs: DataFrame, share: float = 1.5, block: int = 512, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The mix of docs(doc_id, text, source): (pieces, sized).

    sized: (s, doc_id, size, at, source_size, target) for every row, `at` being the place of its first
    word in its source's shuffled stream. pieces: (slot, s, rank, doc_id, at, start, words): the slot of
    the mix that takes `words` words of the row from its word `start` on.

    A source's rows are shuffled by a hash of doc_id, laid end to end and repeated as its target asks
    (at most twice), then cut into blocks of `block` words; slot ranks and blocks meet by (source, rank).
    The last block of a source ends at its target. Null texts have size 0 and are never taken; null
    doc_ids shuffle like any value; null is a source of its own. Rows of one source, doc_id and size are
    counted first and lie end to end, so that neither many rows of one id nor many without an id meet in a
    task. Texts are counted whole. Further columns are not read. Reruns give the same mix.
    """
    scratch = Scratch(spark, "mix")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count_words(F.col("text")).alias("size"))
    sized = scratch.save(sized, "sized")
    targets = source_targets(sized, share, scratch)
    stacks = sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))
    rows = stacks.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    ranges = max(1, -(-sized.count() // RANGE))
    rows = rows.withColumn("mixed", F.xxhash64(F.coalesce("doc_id", F.lit(MAX_LONG)), F.lit(seed))).withColumn("range", F.pmod(F.shiftright("mixed", 40), F.lit(ranges)))
    rows = rows.withColumn("words", F.col("size") * F.col("n"))
    rows = _running(rows, ["s"], "range", [F.col("mixed"), F.col("doc_id"), F.col("size")], "words", "first")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")).withColumn("at", F.col("first") + F.col("copy") * F.col("size"))
    rows = scratch.save(rows.select("s", "doc_id", "size", F.col("at").cast("long").alias("at"), "source_size", "target"), "rows")

    limit = F.floor("target")
    passes = rows.where("size > 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    begin = F.col("at") + F.col("again") * F.col("source_size")
    passes = passes.select("*", begin.alias("low"), F.least(begin + F.col("size"), limit).alias("high")).where("low < high")
    cut = passes.select("*", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))).alias("rank"))
    low, high = F.greatest(F.col("low"), F.col("rank") * block), F.least(F.col("high"), (F.col("rank") + 1) * block)
    cut = cut.select("s", "rank", "doc_id", "at", (low - F.col("low")).alias("start"), (high - low).alias("words"))
    return schedule(spark, targets, block, scratch).join(cut, ["s", "rank"]), rows


def mixed_words(spark: SparkSession, docs: DataFrame, share: float = 1.5) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs: how many of its words the mix takes, repeats counted."""
    pieces, rows = mix(spark, docs, share)
    taken = pieces.groupBy("s", "at").agg(F.sum("words").alias("taken"))
    # a row with words starts at a place of its own; rows without words are never taken
    joined = rows.where("size > 0").join(taken, ["s", "at"], "left")
    out = joined.unionByName(rows.where("size = 0").withColumn("taken", F.lit(None).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
