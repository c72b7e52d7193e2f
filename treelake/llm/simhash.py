"""SimHash near-dedup: word-shingle fingerprints, linked by a pigeonring search in Hamming space."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, slices, texts_of

SHINGLE, SEED, BITS = 3, 42, 64


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, as an unsigned integer; 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split() if text else []  # bytes: lowers A-Z only, splits at 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxh64_intdigest(line, SEED)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = len(words) - SHINGLE + 1
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text never holds all its bits at once
        upto = min(n, at + (1 << 16))
        counts += _bit_counts(np.array([xxh64_intdigest(line[i : j - 1], SEED) for i, j in zip(starts[at:upto], starts[at + SHINGLE : upto + SHINGLE])], np.uint64))
    return _over_half(counts, n)


def _bit_counts(h):
    """How many of the hashes have each bit."""
    import numpy as np

    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS)
    return np.add.reduceat(bits, np.arange(0, len(h), 255), axis=0).sum(0, dtype=np.int64)


def _over_half(counts, n: int) -> int:
    import numpy as np

    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def majority_bits(hashes) -> int:
    """The SimHash of an array of 64-bit hashes; 0 for none."""
    return _over_half(sum(_bit_counts(hashes[at : at + (1 << 16)]) for at in range(0, len(hashes), 1 << 16)), len(hashes)) if len(hashes) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row; fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def ring_chains(segments: int, budget: int) -> list[list[int]]:
    """For each start on the ring: how many differing bits a chain of 1, 2, ... segments may have.

    If two fingerprints differ in at most `budget` bits, then from some start every chain of l
    segments differs in at most l * budget / segments bits (the pigeonring principle).
    """
    return [[(budget * length) // segments for length in range(1, segments + 1)] for _ in range(segments)]


def chain_keys(segments: int, budget: int) -> list[tuple[int, int]]:
    """(start, mask) pairs: equality under one of the masks is necessary for a chain to be viable.

    The chain from a start must agree wholly while its budget is 0, and differ in at most one
    further segment while its budget is 1; each mask leaves that one segment out.
    """
    width = BITS // segments
    part = [((1 << width) - 1) << (width * i) for i in range(segments)]
    out = []
    for start, limits in enumerate(ring_chains(segments, budget)):
        exact = [part[(start + i) % segments] for i, most in enumerate(limits) if most == 0]
        loose = [part[(start + i) % segments] for i, most in enumerate(limits) if most == 1]
        for skipped in range(len(loose)):
            out.append((start, sum(exact) + sum(m for i, m in enumerate(loose) if i != skipped)))
    return out


def _chain_ok(a: str, b: str, start: int, segments: int, budget: int):
    """The chain from `start` keeps within its budget at every length."""
    width, ok, ring = BITS // segments, None, 0
    for i, most in enumerate(ring_chains(segments, budget)[start]):
        ring |= ((1 << width) - 1) << (width * ((start + i) % segments))
        test = F.bit_count(F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(_signed(ring)))) <= most
        ok = test if ok is None else ok & test
    return ok


def hamming_links(spark: SparkSession, fps: DataFrame, scratch: Scratch, budget: int = 3, segments: int = 8, bucket: int = 4096) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints fps(fp) that differ in at most `budget` bits; none is lost.

    Each fingerprint is filed under 24 masks of 32 bits. Within a bucket, a pair must pass the chain
    test before its whole Hamming distance is taken. A bucket of more than `bucket` members is filed
    again: of the 32 bits its mask leaves free at least 5 of 8 groups of 4 must agree, which leaves 12
    free bits, hence at most 4,096 distinct members in a finer bucket, whatever the data.
    """
    if (segments, budget) != (8, 3):
        raise ValueError("masks are laid out for 8 segments and 3 bits")
    masks = chain_keys(segments, budget)
    rows = lambda m: F.explode(F.array(*[F.struct(F.lit(k).cast("short").alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("key")) for k, x in enumerate(m)]))
    filed = scratch.save(fps.select("fp", rows([x for _, x in masks]).alias("r")).select("r.k", "r.key", "fp"), "filed")
    sizes = scratch.save(filed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    near = filed.join(sizes.where(F.col("n") <= bucket).select("k", "key"), ["k", "key"], "left_semi")

    starts = [s for s, _ in masks]
    chain = F.lit(False)
    for start in range(segments):
        own = [k for k, s in enumerate(starts) if s == start]
        chain = chain | (F.col("x.k").isin(own) & _chain_ok("x.fp", "y.fp", start, segments, budget))
    whole = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= budget
    pairs = near.alias("x").join(near.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & chain & whole)
    out = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))

    large = scratch.save(filed.join(sizes.where(F.col("n") > bucket).select("k", "key"), ["k", "key"], "left_semi"), "large")
    if not large.isEmpty():
        finer = []
        for k, (_, mask) in enumerate(masks):
            free = [0xF << s for s in range(0, BITS, 4) if not mask >> s & 0xF]
            finer += [(k, mask + sum(c)) for c in combinations(free, len(free) - budget)]
        per_k = len(finer) // len(masks)
        choice = F.array(*[F.array(*[F.lit(_signed(m)) for kk, m in finer if kk == k]) for k in range(len(masks))])
        fine = (
            large.select("k", "fp", F.explode(F.sequence(F.lit(0), F.lit(per_k - 1))).alias("c"), choice.alias("choice"))
            .select("k", "c", "fp", F.col("fp").bitwiseAND(F.get(F.get("choice", F.col("k").cast("int")), F.col("c"))).alias("key"))
        )
        fine = scratch.save(fine, "fine")
        many = fine.groupBy("k", "c", "key").agg(F.count("*").alias("n")).where("n > 1").select("k", "c", "key")
        fine = fine.join(many, ["k", "c", "key"], "left_semi")
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("k", "c", "key")]
        more = fine.alias("x").join(fine.alias("y"), same[0] & same[1] & same[2] & (F.col("x.fp") < F.col("y.fp")) & whole)
        out = out.unionByName(more.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    return out.distinct()


def simhash_components(spark: SparkSession, docs: DataFrame, budget: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs(doc_id, text, ...).

    Texts are lower-cased (A-Z), split into words and hashed by shingles of three words; fingerprints
    that differ in at most `budget` bits link their documents, and component_id is the smallest doc_id
    reachable. Texts that are null, empty or without words have fingerprint zero and link like any
    other. Rows with a null doc_id are kept; they link documents, but give no component_id (null if
    no linked row has an id). Repeated rows come back as often as given. Further columns are not read.

    Equal fingerprints are folded to one row first (partial sums), so copies cost one fingerprint,
    however many there are.
    """
    scratch = Scratch(spark, "simhash")
    each = scratch.save(fingerprints(docs), "each")
    reps = scratch.save(each.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    links = scratch.save(hamming_links(spark, reps.select("fp"), scratch, budget), "links")
    member = connected_components(spark, links, scratch)
    member = scratch.save(member.join(reps, member.node == reps.fp, "inner").select("fp", "component", "rep"), "member")
    least = scratch.save(member.groupBy("component").agg(F.min("rep").alias("least")), "least")
    linked = scratch.save(member.join(least, "component").select("fp", "least"), "linked")
    of_fp = scratch.save(reps.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "of_fp")
    out = each.join(of_fp, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
