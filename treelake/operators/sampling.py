"""Samples ranked by a hash of (seed, key): the same rows on every run, however the table is partitioned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import dense_index, running_total, saved, with_group


def ticket(seed: int, *keys: Column) -> Column:
    """A portable pseudo-random text: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def draw(seed: int, n: Column, *keys: Column) -> Column:
    """A pseudo-random number from 0 to n - 1."""
    return F.pmod(F.conv(F.substring(ticket(seed, *keys), 1, 12), 16, 10).cast("long"), n)


def numbered(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Adds `out`: 1, 2, ... within each group in the order of `order`. Ranges of all rows are numbered, then the first
    number of a group is taken off, so a group of most rows is dealt to as many tasks as its share. A null in
    `by` is a group of its own."""
    placed = dense_index(df, [*by, *order], "_i", "long")
    # a null equals a null here, other than in a join: a value of the same kind and whether it is null stand in for it
    names = [f"_g{i}" for i in range(2 * len(by))]
    whole = [t in ("int", "bigint", "smallint") for _, t in df.select(*by).dtypes]
    keys = [x for c, w in zip(by, whole) for x in (F.coalesce(F.col(c) if w else F.col(c).cast("string"), F.lit(0 if w else "")), F.col(c).isNull())]
    placed = placed.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    start = placed.groupBy(*names).agg(F.min("_i").alias("_start"), F.count("*").alias("_size"))
    return with_group(placed, start, names, "_size").withColumn(out, F.col("_i") - F.col("_start") + 1).drop("_i", "_start", "_size", *names)


def _ranked(df: DataFrame, by: list[str], seed: int, keys: list[str]) -> DataFrame:
    return numbered(df.withColumn("_t", ticket(seed, *[F.col(k) for k in keys])), by, ["_t", *keys], "_rn").drop("_t")


def simple_sample(df: DataFrame, n: int, seed: int, keys: list[str]) -> DataFrame:
    return df.orderBy(ticket(seed, *[F.col(k) for k in keys]), *keys).limit(n)


def capped_sample(df: DataFrame, by: list[str], cap: int, seed: int, keys: list[str]) -> DataFrame:
    """At most `cap` rows of each group; Spark cuts the ranks off before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(ticket(seed, *[F.col(k) for k in keys]), *keys))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= cap).drop("_rn")


def _dealt(df: DataFrame, seed: int, keys: list[str]) -> DataFrame:
    """Adds the ticket _t and its first three digits _b, one of 4,096 even cells."""
    return df.withColumn("_t", ticket(seed, *[F.col(k) for k in keys])).withColumn("_b", F.substring("_t", 1, 3))


def _cells(dealt: DataFrame, by: str) -> DataFrame:
    """(_by, _cell, _n, _before, _size): rows of a group's cell, rows of its cells before that, rows of the group."""
    counts = dealt.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by"), F.col("_b").alias("_cell")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy("_by")  # at most 4,096 rows
    before = F.sum("_n").over(group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("_before", F.coalesce(before, F.lit(0))).withColumn("_size", F.sum("_n").over(group))


def _in_cell(dealt: DataFrame, cells: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """The rows of these cells with their rank _rn in the cell: (group, cell) is no hot key, whatever a group holds."""
    rank = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_t", *keys))
    return dealt.join(cells, (F.col(by) == F.col("_by")) & (F.col("_b") == F.col("_cell"))).withColumn("_rn", rank)


def fraction_sample(df: DataFrame, by: str, fraction: float, seed: int, keys: list[str]) -> DataFrame:
    """max(1, floor(n * fraction)) rows of each group, without replacement; rows whose group is null are left out."""
    dealt = _dealt(df, seed, keys)
    quota = F.greatest(F.lit(1), F.floor(F.col("_size") * F.lit(fraction) + 1e-9))
    cells = _cells(dealt, by).select("_by", "_cell", (quota - F.col("_before")).alias("_rest")).where("_rest > 0")
    return _in_cell(dealt, cells, by, keys).where("_rn <= _rest").select(*df.columns)


def stratified_subsample(df: DataFrame, by: str, most: int, seed: int, keys: list[str]) -> DataFrame:
    """Exactly `most` rows, or all if fewer: each group's share (1 at least) first, then by hash. Rows whose group is null are left out.

    The counts of cells say how many first and late rows each cell of tickets holds, and so in which cell
    either kind ends; only rows up to there are sorted, and only those of the last cell are ranked among all groups.
    """
    dealt = _dealt(df, seed, keys)
    cells = saved(_cells(dealt, by), "cells")
    total = cells.agg(F.sum("_n").alias("_total"))
    quota = F.greatest(F.lit(1), F.floor(F.lit(float(most)) * F.col("_size") / F.col("_total") + 1e-9))
    parted = cells.join(F.broadcast(total), F.lit(True)).withColumn("_first", F.greatest(F.lit(0), F.least(F.col("_n"), quota - F.col("_before"))))
    every = Window.orderBy("_late", "_cell").rowsBetween(Window.unboundedPreceding, -1)  # at most 8,192 rows
    kinds = parted.select("_cell", F.explode(F.array(F.struct(F.lit(0).alias("_late"), F.col("_first").alias("_n")), F.struct(F.lit(1).alias("_late"), (F.col("_n") - F.col("_first")).alias("_n")))).alias("_k"))
    kinds = kinds.groupBy("_cell", F.col("_k._late").alias("_late")).agg(F.sum("_k._n").alias("_n"))
    kinds = kinds.withColumn("_room", F.lit(most) - F.coalesce(F.sum("_n").over(every), F.lit(0))).where("_room > 0 and _n > 0")
    ends = kinds.groupBy("_cell").agg(*[F.coalesce(F.max(F.when(F.col("_late") == k, F.col("_room"))), F.lit(0)).alias(f"_room{k}") for k in (0, 1)])
    ends = ends.join(kinds.groupBy("_cell").agg(*[F.coalesce(F.max(F.when(F.col("_late") == k, F.col("_n"))), F.lit(0)).alias(f"_all{k}") for k in (0, 1)]), "_cell")
    wanted = parted.join(ends, "_cell").where("(_first > 0 and _room0 > 0) or (_first < _n and _room1 > 0)")
    rows = _in_cell(dealt, wanted.select("_by", "_cell", "_first", "_room0", "_room1", "_all0", "_all1"), by, keys)
    rows = rows.withColumn("_late", (F.col("_rn") > F.col("_first")).cast("int"))
    room, among = (F.when(F.col("_late") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1")) for c in ("_room", "_all"))
    rows = saved(rows.select(*df.columns, "_t", "_b", "_late", room.alias("_room"), among.alias("_among")).where("_room > 0"), "sampled")
    last = rows.where("_room < _among").withColumn("_rn", F.row_number().over(Window.partitionBy("_late", "_b").orderBy("_t", *keys))).where("_rn <= _room")
    return rows.where("_room >= _among").select(*df.columns).unionByName(last.select(*df.columns))


def class_balanced(df: DataFrame, by: str, total: int, seed: int, keys: list[str]) -> DataFrame:
    """max(1, total // classes) rows of each class, with replacement where the class is smaller; adds draw_no."""
    sizes = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    classes = sizes.agg(F.count("*").alias("_classes"))
    quota = sizes.join(F.broadcast(classes), F.lit(True)).withColumn("_quota", F.greatest(F.lit(1), F.floor(F.lit(total) / F.col("_classes"))).cast("int"))
    wanted = quota.select("_by", "_n", F.explode(F.sequence(F.lit(1), F.col("_quota"))).alias("draw_no"), "_quota")
    place = F.when(F.col("_n") >= F.col("_quota"), F.col("draw_no").cast("long")).otherwise(draw(seed, F.col("_n"), F.col("_by"), F.col("draw_no")) + 1)
    wanted = wanted.select("_by", "draw_no", place.alias("_place"))
    ranked = _ranked(df, [by], seed, keys)
    return ranked.join(wanted, (F.col(by) == F.col("_by")) & (F.col("_rn") == F.col("_place"))).drop("_rn", "_by", "_place")


def proportional_sample(df: DataFrame, by: str, size: int, seed: int, keys: list[str]) -> DataFrame:
    """min(n, max(1, floor(n / N * size))) of each group, then topped up to `size` from all unsampled rows."""
    return stratified_subsample(df, by, size, seed, keys)


def batches(df: DataFrame, size: int, seed: int, keys: list[str]) -> DataFrame:
    """Adds batch: rows in hash order, `size` to a batch."""
    mixed = df.withColumn("_t", ticket(seed, *[F.col(k) for k in keys]))
    return dense_index(mixed, ["_t", *keys], "_at").withColumn("batch", F.floor(F.col("_at") / size).cast("int")).drop("_t", "_at")


def pool(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Adds pos (0.. in order of idx) and pool_size within each group: a table to draw from by equi-join."""
    held = nodes.dropna(subset=by)
    sizes = held.groupBy(*by).agg(F.count("*").alias("pool_size"))
    return with_group(numbered(held, by, ["idx"], "_at").withColumn("pos", F.col("_at") - 1).drop("_at"), sizes, by, "pool_size")


def pool_negatives(wanted: DataFrame, pools: DataFrame, by: list[str], seed: int, tier: str) -> DataFrame:
    """A draw for each row of wanted(descendant_idx, draw_no, <by>, ...), from pool(nodes, by): adds negative_idx and tier.

    Where the pool is empty, or the draw is the node itself, negative_idx is null; the caller fills it from
    the next tier. The draws meet the pool on (group, position), so a large pool is no hot key.
    """
    sizes = pools.groupBy(*by).agg(F.max("pool_size").alias("pool_size"))
    drawn = with_group(wanted, sizes, by, "pool_size", "left").withColumn("pos", draw(seed, F.col("pool_size"), F.lit(tier), F.col("descendant_idx"), F.col("draw_no")))
    hit = drawn.join(pools.select(*by, "pos", F.col("idx").alias("_hit")), [*by, "pos"], "left")
    other = F.when(F.col("_hit") != F.col("descendant_idx"), F.col("_hit"))
    return hit.select(*wanted.columns, other.alias("negative_idx"), F.lit(tier).alias("tier"))


def negatives(nodes: DataFrame, k: int, seed: int, tiers: list[tuple[str, list[str], int]], positives: DataFrame | None = None) -> DataFrame:
    """(descendant_idx, draw_no, negative_idx, tier): k negatives for each of nodes(idx, <columns of the tiers>).

    tiers: (name, columns, last draw_no) in order; draws up to that number come from the pool of nodes
    that agree in these columns. What a tier can't give falls to the last tier, and then to any node; a
    node is never its own negative (in a tree of one node there is none). With positives(idx, negative_idx), idx
    running 0..n-1, draws that hit one are replaced by the node's `eligible_draws` of the same number (tier "eligible");
    a node with no other left has none.
    """
    out = ["descendant_idx", "draw_no", "negative_idx", "tier"]
    nodes = saved(nodes, "nodes")
    wanted = nodes.select(F.col("idx").alias("descendant_idx"), *[c for c in nodes.columns if c != "idx"], F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw_no"))
    parts, low = [], 0
    for name, by, high in tiers:
        pools = saved(pool(nodes.select("idx", *by), by), "pool")
        parts.append(pool_negatives(wanted.where((F.col("draw_no") > low) & (F.col("draw_no") <= high)), pools, by, seed, name))
        low = high
    if low < k:
        parts.append(wanted.where(F.col("draw_no") > low).withColumns({"negative_idx": F.lit(None).cast("int"), "tier": F.lit(None).cast("string")}))
    tried = saved(reduce(DataFrame.unionByName, parts), "negatives")
    left = tried.where("negative_idx is null").drop("negative_idx", "tier")
    again = saved(pool_negatives(left, pools, by, seed + 1, name), "negatives")
    size = nodes.agg(F.count("*").alias("n"))
    left = again.where("negative_idx is null").join(F.broadcast(size), F.lit(True)).where("n > 1")
    # any node but itself: a step of 1 to n - 1 from its own index
    step = draw(seed, F.col("n") - 1, F.lit("random"), F.col("descendant_idx"), F.col("draw_no")) + 1
    anywhere = left.select("descendant_idx", "draw_no", F.pmod(F.col("descendant_idx") + step, F.col("n")).cast("int").alias("negative_idx"), F.lit("random").alias("tier"))
    found = tried.where("negative_idx is not null").select(*out).unionByName(again.where("negative_idx is not null").select(*out)).unionByName(anywhere)
    if positives is None:
        return found
    taken = positives.select(F.col("idx").alias("descendant_idx"), "negative_idx").distinct()
    found = saved(found.join(taken, ["descendant_idx", "negative_idx"], "left_anti"), "negatives")
    lack = wanted.select("descendant_idx", "draw_no").join(found, ["descendant_idx", "draw_no"], "left_anti")
    exact = rejecting_negatives(lack.select(F.col("descendant_idx").alias("idx")).distinct(), positives, k, seed, nodes.count())
    return found.unionByName(lack.join(exact, ["descendant_idx", "draw_no"]).where("negative_idx <> descendant_idx").select("descendant_idx", "draw_no", "negative_idx", F.lit("eligible").alias("tier")))


def _marks_up_to(points: DataFrame, marks: DataFrame, order: list[str], out: str, equal: bool = True) -> DataFrame:
    """points with `out`: how many rows of marks(<order>) come before the point in this order; equal ones count, or don't.

    Both are sorted together in ranges, so neither a group with most marks nor one with most points is ever in one task.
    """
    rest = [F.lit(0).alias("_"), *[c for c in points.columns if c not in order]]  # a struct needs a field
    first, last = (marks, points) if equal else (points, marks)
    kind = lambda df, k: df.select(*order, F.lit(k).alias("_kind"), F.lit(df is marks).alias("_mark"), *([F.struct(*rest).alias("_row")] if df is points else []))
    placed = running_total(kind(first, 0).unionByName(kind(last, 1), allowMissingColumns=True), [*order, "_kind"], F.col("_mark").cast("long"), "_count")
    return placed.where("not _mark").select(*order, "_row.*", F.col("_count").alias(out)).drop("_")


def _spread(i: Column, k: int, m: Column, seed: int, *keys: Column) -> Column:
    """The i-th (from 0) of k different numbers below m, one in each of k even stretches; where m < k, each once and then repeats."""
    low, high = F.floor(i * m / k), F.floor((i + 1) * m / k)
    even = low + draw(seed, F.greatest(high - low, F.lit(1)), *keys)
    return F.when(m >= k, even).when(i < m, i).otherwise(draw(seed, F.greatest(m, F.lit(1)), *keys))


def eligible_draws(wanted: DataFrame, links: DataFrame, k: int, seed: int, n: int, keys: list[str]) -> DataFrame:
    """(idx, <keys>, draw_no, negative_idx): k draws among 0..n-1 for each row of wanted(idx, weight, <keys>), without rejection.

    links(idx, other, weight): a row may draw any node that its idx isn't linked to, and those it is linked to by less
    than the row's weight; never idx itself. Of several links of a pair the greatest weight holds. A null weight
    draws among unlinked nodes only. All k are different if so many may be drawn; else each of them comes once, and
    the rest of the k repeats them; if none may be drawn, all k are idx itself, which tells a caller that there is none.

    A row numbers its choice: unlinked nodes by index, then lighter links by (weight, index). Each of its k draws is
    one of an even stretch of these numbers, so they differ without a second look. The r-th link l of a node (from 0) has
    l - r unlinked nodes before it, so number j stands for the node j plus the count of links with l - r <= j. That
    count comes from sorting links and draws together, so a node with most links is dealt to many ranges.
    """
    kind = links.schema["other"].dataType
    own = wanted.select("idx").distinct()
    held = saved(links.where("idx <> other").groupBy("idx", "other").agg(F.max("weight").alias("weight")).join(own, "idx", "left_semi"), "links")
    placed = saved(dense_index(held.select("idx", "other").unionByName(own.select("idx", F.col("idx").alias("other"))), ["idx", "other"], "_i", "long"), "placed")
    heavy = saved(dense_index(held, ["idx", "weight", "other"], "_j", "long"), "by_weight")
    facts = placed.groupBy("idx").agg(F.min("_i").alias("_start"), (F.lit(n) - F.count("*")).alias("_free"))
    facts = facts.join(heavy.groupBy("idx").agg(F.min("_j").alias("_first")), "idx", "left")
    asked = wanted.where("weight is not null").select("idx", "weight").distinct()
    lighter = _marks_up_to(asked, held.select("idx", "weight"), ["idx", "weight"], "_light", equal=False)
    rows = wanted.join(facts, "idx").join(lighter, ["idx", "weight"], "left")
    rows = rows.withColumn("_may", F.col("_free") + F.coalesce(F.col("_light") - F.col("_first"), F.lit(0)))
    draws = rows.select("idx", *keys, "_start", "_first", "_free", "_may", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_no"))
    number = _spread(F.col("_no").cast("long"), k, F.col("_may"), seed, F.col("idx"), *[F.col(c) for c in keys], F.col("_no"))
    draws = saved(draws.withColumn("_j", F.when(F.col("_may") > 0, number).cast("long")), "draws")
    out = ["idx", *keys, (F.col("_no") + 1).alias("draw_no")]
    none = draws.where("_j is null").select(*out, F.col("idx").cast(kind).alias("negative_idx"))
    # both sides leave out the number of links of smaller nodes: l - i <= j - start is l - r <= j
    free = draws.where("_j < _free").select("idx", (F.col("_j") - F.col("_start")).alias("_at"), *keys, "_no")
    free = _marks_up_to(free, placed.select("idx", (F.col("other") - F.col("_i")).cast("long").alias("_at")), ["idx", "_at"], "_before")
    free = free.select(*out, (F.col("_at") + F.col("_before")).cast(kind).alias("negative_idx"))
    light = draws.where("_j >= _free").withColumn("_j", F.col("_first") + F.col("_j") - F.col("_free")).join(heavy.select("_j", F.col("other").alias("negative_idx")), "_j")
    return free.unionByName(light.select(*out, "negative_idx")).unionByName(none)


def rejecting_negatives(nodes: DataFrame, positives: DataFrame, k: int, seed: int, n: int | None = None) -> DataFrame:
    """(descendant_idx, draw_no, negative_idx): exactly k negatives for each of nodes(idx), never one of its positives.

    Indices run 0..n-1; n is the number of nodes if none is given. positives(idx, negative_idx). See `eligible_draws`: they
    differ if there are k to draw from, else all come and some repeat; a node that is linked to all others gets itself.
    """
    links = positives.select("idx", F.col("negative_idx").alias("other"), F.lit(1.0).alias("weight"))
    wanted = nodes.select("idx", F.lit(None).cast("double").alias("weight"))
    return eligible_draws(wanted, links, k, seed, nodes.count() if n is None else n, []).withColumnRenamed("idx", "descendant_idx")


def weight_rejecting_negatives(links: DataFrame, k: int, seed: int, n: int) -> DataFrame:
    """(idx, other, draw_no, negative_idx): k negatives for each of links(idx, other, weight): nodes of 0..n-1 that idx isn't
    linked to, or by less weight than to `other`. Exactly k, as `eligible_draws` says; repeated links are one, of the greatest weight."""
    one = links.where("idx <> other").groupBy("idx", "other").agg(F.max("weight").cast("double").alias("weight"))
    one = saved(one, "weighted")
    return eligible_draws(one, one, k, seed, n, ["other"])


def weighted_draws(weights: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw_no, id): n draws with replacement from weights(id, weight), by inverting the cumulative weights.

    Draws and the lower ends of the weights' stretches are sorted together, so a draw's place among them is its id's
    place in the order of ids, whatever the number of ids.
    """
    held = weights.where("weight > 0").select("id", F.col("weight").cast("double").alias("weight"))
    ends = saved(running_total(held, ["id"], F.col("weight"), "_high"), "ends").withColumn("_at", F.col("_high") - F.col("weight"))
    total = ends.agg(F.max("_high").alias("total"))  # one row
    point = draw(seed, F.lit(1 << 40), F.col("id")) / float(1 << 40)
    draws = weights.sparkSession.range(1, n + 1).join(F.broadcast(total), F.lit(True)).select(F.col("id").alias("draw_no"), (point * F.col("total")).alias("_at"))
    placed = _marks_up_to(draws.where("_at is not null"), ends.select("_at"), ["_at"], "_place")
    return placed.join(dense_index(ends.select("id"), ["id"], "_i", "long"), F.col("_place") == F.col("_i") + 1).select("draw_no", "id")
