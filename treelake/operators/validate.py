"""Checks of input tables, each as one row or as a list of issues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dense_index


def validate_edgelist(lines: DataFrame) -> DataFrame:
    """(line_no, issue) for lines(line_no, value): not two tokens, or not whole numbers."""
    tokens = F.split(F.trim("value"), r"\s+")
    bad = F.when(F.size(tokens) != 2, "not two tokens").when(~F.forall(tokens, lambda t: F.regexp_like(t, F.lit("^-?[0-9]+$"))), "not a whole number")
    return lines.select("line_no", bad.alias("issue")).where("issue is not null")


def validate_mapping(mapping: DataFrame) -> DataFrame:
    """One row for mapping(taxid string, idx): counts of bad rows and whether idx runs 0..n-1 without repeats."""
    ids = mapping.agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.regexp_like(F.col("taxid").cast("string"), F.lit("^[0-9]+$")), F.lit(False))).alias("bad_taxids"),
        F.count("idx").alias("with_idx"), F.min("idx").alias("least"), F.max("idx").alias("most"),
    )
    twice = lambda c: mapping.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias(f"repeated_{c}"))
    both = ids.join(F.broadcast(twice("taxid")), F.lit(True)).join(F.broadcast(twice("idx")), F.lit(True))
    dense = (F.col("with_idx") == F.col("n")) & (F.col("least") == 0) & (F.col("most") == F.col("n") - 1) & (F.col("repeated_idx") == 0)
    return both.select("n", "bad_taxids", "repeated_taxid", "repeated_idx", F.coalesce(dense, F.lit(False)).alias("is_dense"))


def validate_consistency(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: edge nodes, how many of them have no index, mapped ids, how many of them are in no edge."""
    used = edges.select(F.explode(F.array("parent", "child")).alias("taxid")).distinct()
    ids = mapping.select("taxid").distinct()
    a = used.join(ids.withColumn("m", F.lit(1)), "taxid", "left").agg(F.count("*").alias("edge_nodes"), F.count_if(F.col("m").isNull()).alias("unmapped"))
    b = ids.join(used.withColumn("u", F.lit(1)), "taxid", "left").agg(F.count("*").alias("mapped"), F.count_if(F.col("u").isNull()).alias("unused"))
    return a.join(F.broadcast(b), F.lit(True))


def sanity(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of counts that should all be 0, for a table of pairs and its mapping."""
    n = mapping.agg(F.count("*").alias("n_nodes"))
    p = pairs.join(F.broadcast(n), F.lit(True))
    return p.agg(
        F.count("*").alias("pairs"), F.count_if((F.col("ancestor_idx") < 0) | (F.col("ancestor_idx") >= F.col("n_nodes")) | (F.col("descendant_idx") < 0) | (F.col("descendant_idx") >= F.col("n_nodes"))).alias("out_of_range"),
        F.count_if(F.col("ancestor_idx") == F.col("descendant_idx")).alias("self_pairs"), F.count_if(F.col("depth_diff") != F.col("descendant_depth") - F.col("ancestor_depth")).alias("inconsistent"), F.count_if(F.col("depth_diff") < 1).alias("not_positive"),
    )


def node_roles(pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(role, n): only ancestor, only descendant, both or never, of all mapped nodes."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("ancestor_idx").alias("idx"), F.lit(1).alias("a"), F.lit(0).alias("d")), F.struct(F.col("descendant_idx").alias("idx"), F.lit(0).alias("a"), F.lit(1).alias("d")))).alias("e")).select("e.*")
    flags = ends.groupBy("idx").agg(F.max("a").alias("a"), F.max("d").alias("d"))
    both = mapping.select("idx").join(flags, "idx", "left")
    role = F.when((F.col("a") == 1) & (F.col("d") == 1), "both").when(F.col("a") == 1, "ancestor").when(F.col("d") == 1, "descendant").otherwise("never")
    return both.groupBy(role.alias("role")).agg(F.count("*").alias("n"))


def edge_totals(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct parents, children and nodes. Ends are counted once each first."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("parent").alias("taxid"), F.lit(1).alias("p"), F.lit(0).alias("c")), F.struct(F.col("child").alias("taxid"), F.lit(0).alias("p"), F.lit(1).alias("c")))).alias("e")).select("e.*")
    by = ends.groupBy("taxid").agg(F.max("p").alias("p"), F.max("c").alias("c"))
    return by.agg(F.sum("p").alias("parents"), F.sum("c").alias("children"), F.count("*").alias("nodes"))


def id_gaps(ids: DataFrame, column: str) -> DataFrame:
    """(after, before, missing): stretches of whole numbers between the least and the largest of a column that it lacks.

    Numbers less their place in order are constant over a run without gaps; runs are numbered, and each meets the next.
    """
    held = ids.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("v")).distinct()
    runs = dense_index(held, ["v"], "_i", "long").groupBy((F.col("v") - F.col("_i")).alias("_k")).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    runs = dense_index(runs, ["low"], "_n", "long")
    after = runs.select("_n", F.col("high").alias("after"))
    return after.join(runs.select((F.col("_n") - 1).alias("_n"), F.col("low").alias("before")), "_n").select("after", "before", (F.col("before") - F.col("after") - 1).alias("missing"))


def ten_checks(edges: DataFrame, mapping: DataFrame, pairs: DataFrame, vectors: DataFrame, links: DataFrame) -> DataFrame:
    """(check, bad): how many rows break each of ten rules; 0 everywhere for a sound dataset.

    mapping(taxid, idx), pairs with depths, vectors(idx, vec, depth, target) as a training starts, links(ancestor_idx,
    descendant_idx, negatives). The rules: one index an id; one id an index; indices without gaps; ends of pairs are
    mapped; no pair of a node with itself; depths of a pair agree; every edge is a pair; vectors lie in the ball;
    each at its target radius; no negative is its own descendant.
    """
    mapped = mapping.select("idx").distinct()
    twice = lambda c: mapping.groupBy(c).agg(F.count("*").alias("n")).where("n > 1")
    ends = pairs.select(F.explode(F.array("ancestor_idx", "descendant_idx")).alias("idx"))
    by = [mapping.select("taxid", F.col("idx").alias("i")), mapping.select("taxid", F.col("idx").alias("j"))]
    direct = edges.join(by[0], edges.parent == by[0].taxid).select("child", "i").join(by[1], F.col("child") == by[1].taxid).select(F.col("i").alias("ancestor_idx"), F.col("j").alias("descendant_idx"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    bad = {
        "one index an id": twice("taxid"), "one id an index": twice("idx"), "no gaps": id_gaps(mapping.unionByName(mapping.limit(1).select("taxid", F.lit(0).cast("int").alias("idx"))), "idx"), "ends are mapped": ends.join(mapped, "idx", "left_anti"),
        "no self pairs": pairs.where("ancestor_idx = descendant_idx"), "depths agree": pairs.where("depth_diff <> descendant_depth - ancestor_depth or depth_diff < 1"), "edges are pairs": direct.join(pairs, ["ancestor_idx", "descendant_idx"], "left_anti"),
        "inside the ball": vectors.where(norm >= 1), "at the target radius": vectors.where(F.abs(norm - F.col("target")) > 1e-6), "negatives are others": links.where(F.array_contains("negatives", F.col("descendant_idx"))),
    }
    return reduce(DataFrame.unionByName, [rows.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad") for name, rows in bad.items()])
