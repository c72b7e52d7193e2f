"""Near-dedup of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash's pigeonring search gives the first candidates. Sets of similarity 0.8 differ in about 10 of 64 bits, far beyond
what masks can find, so min-hash keys give the rest; every candidate is checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, slices, texts_of, unused
from .simhash import hamming_links, majority_bits

SHINGLE, SEED = 5, 42
#: A pair of similarity 0.8 shares none of 32 keys of five minima with a chance of (1 - 0.8^5)^32 = 3e-6, more similar ones with less.
BANDS, ROWS = 32, 5
#: Words of 64 bits for the bound on the difference of two sets.
PARITY = 32


def shingles(text: bytes | None):
    """The sorted, different 64-bit hashes of the five-word shingles of a UTF-8 text; a shorter text is one shingle, none without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.unique(np.array([xxh64_intdigest(line[i : j - 1], SEED) for i, j in zip(starts, starts[SHINGLE:])], np.uint64))


@lru_cache(1)
def _multipliers():
    import numpy as np

    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(hashes):
    """A key for each band, from the minima of its hash functions; none for an empty set."""
    import numpy as np

    if not len(hashes):
        return np.zeros(0, np.int64)
    factor, plus = _multipliers()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[None, at : at + 1024] * factor + plus).min(1))
    key = np.zeros(BANDS, np.uint64)
    for part in least.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def parity_bits(hashes):
    """Bit i of PARITY words of 64 bits: whether the set holds an odd number of hashes with this remainder.

    An element that only one of two sets has changes one bit at most, so their bits differ in no more
    places than the sets: a bound on the similarity that loses nothing.
    """
    import numpy as np

    odd = np.bincount((hashes % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _lists(arrays):
    import numpy as np
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, arrays)]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, node, n, fp, keys) for every row; t1 is a hash of the text, node of the set of shingles, n its size, fp its SimHash, bits its parities."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for b in slices(batches):
            sets = [shingles(t) for t in texts_of(b)]
            node, fp = (np.array([f(s) for s in sets], np.uint64).view(np.int64) for f in (lambda s: xxh64_intdigest(s.tobytes(), SEED), majority_bits))
            columns = [b.column("doc_id"), b.column("t1"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), _lists([parity_bits(s) for s in sets]), _lists([band_keys(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t1", "node", "n", "fp", "bits", "keys"])

    return _rows(docs).mapInArrow(run, "doc_id long, t1 long, node long, n long, fp long, bits array<long>, keys array<long>")


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), text.alias("text"))


def _sets(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, hashes) of asked(node, rep, t1), from a row of docs that has this id and text."""
    rows = _rows(docs).join(asked.withColumnRenamed("t1", "_t1"), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("t1") == F.col("_t1"))).select("node", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("node"), _lists([shingles(t) for t in texts_of(b)])], ["node", "hashes"])

    return rows.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def _fits(x: str, y: str):
    """The sizes of two sets allow a similarity of 0.8."""
    return 5 * F.least(x, y) >= 4 * F.greatest(x, y)


def _differ(x: str, y: str):
    """In how many places the parities of two sets differ."""
    parts = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITY)]
    return sum(parts[1:], parts[0])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets(node, hashes) have an exact Jaccard similarity of at least 0.8."""
    x = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    y = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    both = pairs.join(x, "b").join(y, "a")  # in whole numbers: 9 i >= 4 (m + n) where i / (m + n - i) >= 0.8
    return both.where(9 * F.size(F.array_intersect("ha", "hb")) >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")


def close_fingerprints(spark: SparkSession, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) of nodes(node, n, fp): a node and the leader of its fingerprint, and that leader and the leader of the
    smallest fingerprint within 3 bits."""
    each = nodes.select("node", F.col("n").alias("m"), "fp")
    leads = scratch.save(each.groupBy("fp").agg(F.min(F.struct("node", "m")).alias("l")), "leads")
    near = hamming_links(spark, leads.select("fp"), scratch).groupBy("b").agg(F.min("a").alias("a"))
    near = scratch.save(near, "near-fps")
    own = each.join(leads, "fp").select(F.col("l.node").alias("x"), F.col("l.m").alias("m"), F.col("node").alias("y"), F.col("m").alias("n"))
    side = lambda fp, x, m: leads.select(F.col("fp").alias(fp), F.col("l.node").alias(x), F.col("l.m").alias(m))
    across = near.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b").select("x", "m", "y", "n")
    return own.unionByName(across).where((F.col("x") != F.col("y")) & _fits("m", "n")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _components(spark: SparkSession, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    part = connected_components(spark, links, Scratch(spark, "neardup-" + name))
    return scratch.save(part.select(F.col("node").alias("_node"), "component"), name)


def similar_links(spark: SparkSession, docs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) of exact similarity 0.8 or more that join all such candidates of nodes(node, n, fp, bits, keys, rep, t1).

    Candidates are close by fingerprint or share a band's key. First come the former, and each node meets the most
    central of the leaders of its buckets. A bucket has two: that whose buckets hold most in all, as the text that
    the others are copies of does, and one by hash. Then each node meets those leaders that are still in another component; at last
    all members of a bucket that are still in different components meet, and those pairs stay whose parities
    allow the similarity (see parity_bits). So no candidate is left out but
    those that couldn't change a component, and a bucket of many alike makes few pairs.
    """
    filed = scratch.save(nodes.select("node", "n", F.posexplode("keys").alias("band", "key")), "filed")
    sizes = scratch.save(filed.groupBy("band", "key").agg(F.count("*").alias("_n")).where("_n > 1"), "sizes")
    near = scratch.save(filed.join(sizes, ["band", "key"]), "near-sizes")
    central = scratch.save(near.groupBy("node").agg(F.sum("_n").alias("w")), "central")
    near = scratch.save(near.drop("_n").join(central, "node"), "near")
    lead = F.struct("node", "n", "w")
    many = near.groupBy("band", "key").agg(F.max_by(lead, F.struct("w", "node")).alias("l0"), F.min_by(lead, F.xxhash64("node")).alias("l1"))
    many = scratch.save(many, "many")
    scratch.drop("near-sizes")
    scratch.drop("filed")
    close = scratch.save(close_fingerprints(spark, nodes, scratch), "close")
    asked = near.select("node").unionByName(close.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = scratch.save(_sets(docs, nodes.select("node", "rep", "t1").join(asked, "node", "left_semi")), "candidates")
    scratch.release()
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    led = near.join(many.select("band", "key", F.explode(F.array("l0", "l1")).alias("l")), ["band", "key"])
    led = led.select("node", "n", F.col("l.node").alias("lead"), F.col("l.n").alias("m"), F.col("l.w").alias("w")).where((F.col("node") != F.col("lead")) & _fits("n", "m"))
    led = scratch.save(led.select("node", "lead", "w").distinct(), "led")
    first = led.groupBy("node").agg(F.max_by("lead", F.struct("w", "lead")).alias("lead")).select(*ordered("node", "lead")).unionByName(close)
    first = scratch.save(first.distinct(), "first")
    links = scratch.save(similar(first, sets), "links-1")
    part = _components(spark, links, scratch, "parts-1")

    of = lambda c: part.select(F.col("_node").alias(c), F.col("component").alias(f"_{c}"))
    other = led.join(of("node"), "node", "left").join(of("lead"), "lead", "left")
    other = other.where(F.coalesce("_node", "node") != F.coalesce("_lead", "lead")).select(*ordered("node", "lead")).distinct()
    other = scratch.save(other.join(first, ["a", "b"], "left_anti"), "other")
    links = scratch.save(links.unionByName(similar(other, sets)), "links-2")
    part = _components(spark, links, scratch, "parts-2")

    near = near.join(part, F.col("node") == F.col("_node"), "left").select("band", "key", "node", "n", F.coalesce("component", "node").alias("c"))
    mixed = near.groupBy("band", "key").agg(F.min("c").alias("_l"), F.max("c").alias("_m")).where("_l < _m").select("band", "key")
    near = near.join(mixed, ["band", "key"], "left_semi").join(nodes.select("node", "bits"), "node")
    near = scratch.save(near, "mixed")
    x, y = near.alias("x"), near.alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key"))
    close = 9 * _differ("x.bits", "y.bits") <= F.col("x.n") + F.col("y.n")  # m + n - 2 i <= (m + n) / 9 where i / (m + n - i) >= 0.8
    rest = x.join(y, same & (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c")) & _fits("x.n", "y.n") & close)
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct().join(first.unionByName(other), ["a", "b"], "left_anti")
    more = scratch.save(similar(scratch.save(rest, "rest"), sets), "links-3")
    for name in ("candidates", "near", "led", "mixed"):
        scratch.drop(name)
    scratch.release()
    return links.unionByName(more)


def keep_one_per_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns.

    Texts are lower-cased (A-Z) and split into words; a Jaccard similarity of 0.8 or more between the sets
    of five-word shingles links two documents, and groups are what links reach. Texts without words
    are alike. Rows without a doc_id come after all others: they go if their group has an id, else one of them stays, a row
    of the text whose hash is least. Of rows that repeat a doc_id, all stay or all go. Candidates come from min-hash
    keys, see BANDS; their similarity is exact.
    """
    scratch = Scratch(spark, "neardup")
    each = scratch.save(_keyed(docs), "each")
    first = [F.first(c).alias(c) for c in ("n", "fp", "bits", "keys")]
    order = lambda rep: F.struct(F.col(rep).isNull().alias("last"), F.col(rep).alias("rep"), F.col("t1").alias("t1"))
    nodes = each.groupBy("node").agg(F.min(order("doc_id")).alias("r"), *first)
    nodes = scratch.save(nodes.select("node", F.col("r.rep").alias("rep"), F.col("r.t1").alias("t1"), "n", "fp", "bits", "keys"), "nodes")
    links = similar_links(spark, docs, nodes, scratch)
    member = connected_components(spark, links, scratch)
    member = scratch.save(member.join(nodes.select(F.col("node").alias("_node"), "rep", "t1"), F.col("node") == F.col("_node")).select("node", "component", "rep", "t1"), "member")
    least = scratch.save(member.groupBy("component").agg(F.min(order("rep")).alias("least")), "least")
    linked = scratch.save(member.join(least, "component").select(F.col("node").alias("_node"), "least"), "linked")
    of_node = nodes.select("node", order("rep").alias("own")).join(linked, F.col("node") == F.col("_node"), "left").select("node", F.coalesce("least", "own").alias("least"))
    of_node = scratch.save(of_node, "of-node")
    key, own = unused(docs, "_gone"), unused(docs, "_text")
    later = F.when(F.col("doc_id").isNull(), F.col("least.rep").isNotNull() | (F.col("least.t1") != F.col("t1"))).otherwise(F.col("least.rep") < F.col("doc_id"))
    by_text = F.when(F.col("doc_id").isNull(), F.col("t1"))
    gone = scratch.save(each.select("doc_id", "t1", "node").join(of_node, "node").where(later).select(F.col("doc_id").alias(key), by_text.alias(own)).distinct(), "gone")
    scratch.release()
    text = F.xxhash64(F.col("text").cast("string"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.when(F.col("doc_id").isNull(), text).eqNullSafe(F.col(own))
    kept = docs.join(gone, same, "left_anti")
    nameless = kept.where("doc_id is null").withColumn(own, text).dropDuplicates([own]).drop(own)
    return kept.where("doc_id is not null").unionByName(nameless)
