"""Substring dedup: passages of 50 words that an earlier document has too, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, slices, texts_of, unused

#: A perfect difference cover: every residue modulo 31 is the difference of two of these.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Odd multipliers of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _word_hashes(words: list[bytes], memo: dict[bytes, int]):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    if len(memo) > 100_000:  # about 20 MB
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = xxh3_64_intdigest(w)
    return np.array([memo[w] for w in words], np.uint64)


def _rolling(h, length: int, base: int):
    """Hash of every run of `length` words, from prefix sums of h[i] * base^i modulo 2^64."""
    import numpy as np

    n = len(h)
    if n < length:
        return np.zeros(0, np.uint64)
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers, out=sums[1:])
    back = np.full(n - length + 1, pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    return (sums[length:] - sums[:-length]) * np.cumprod(back)


def _at_cover(n: int):
    import numpy as np

    return np.nonzero(np.isin(np.arange(n) % PERIOD, COVER))[0]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, t1): each hash of window - 30 words at a cover position, once for each text; a task skips texts it has seen lately."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memo: dict[bytes, int] = {}
        seen: set[int] = set()
        for b in slices(batches):
            hs, keys = [], []
            for key, text in zip(b.column("t1").to_pylist(), texts_of(b)):
                if not text or key in seen:
                    continue
                if len(seen) > 1 << 20:
                    seen.clear()
                seen.add(key)
                words = text.split()
                if len(words) >= window:
                    a = _rolling(_word_hashes(words, memo), window - PERIOD + 1, BASES[0])
                    a = np.unique(a[_at_cover(len(a))])
                    hs.append(a.view(np.int64))
                    keys.append(np.full(len(a), key, np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs)), pa.array(np.concatenate(keys))], ["h", "t1"])

    return docs.select("t1", "text").mapInArrow(run, "h long, t1 long")


def _candidate_windows(docs: DataFrame, window: int) -> DataFrame:
    """(w1, w2, doc, t1): windows around the shared anchors of a document, once for each row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memo: dict[bytes, int] = {}
        for b in slices(batches):
            out, rows = [], []
            for row, (text, shared) in enumerate(zip(texts_of(b), b.column("shared"))):
                words = text.split() if text else []
                if len(words) < window:
                    continue
                h = _word_hashes(words, memo)
                a = _rolling(h, window - PERIOD + 1, BASES[0])
                at = _at_cover(len(a))
                at = at[np.isin(a[at].view(np.int64), shared.values.to_numpy(zero_copy_only=False))]
                n = len(words) - window + 1
                edge = np.zeros(n + PERIOD + 1, np.int64)  # an anchor at p lies in the windows that start at p - 30 to p
                np.add.at(edge, np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(edge, np.minimum(at + 1, n), -1)
                starts = np.nonzero(np.cumsum(edge)[:n] > 0)[0]
                if len(starts):
                    w1, w2 = (_rolling(h, window, x)[starts].view(np.int64) for x in BASES)
                    _, first = np.unique(w1, return_index=True)
                    out.append((w1[first], w2[first]))
                    rows.append(np.full(len(first), row))
            if out:
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(x)) for x in zip(*out)], b.column("doc").take(at), b.column("t1").take(at)], ["w1", "w2", "doc", "t1"])

    return docs.select("doc", "t1", "text", "shared").mapInArrow(run, "w1 long, w2 long, doc long, t1 long")


def _removed(words: list[bytes], gone, whole: bool, window: int, memo: dict[bytes, int]):
    """A flag for each word: whether one of the windows named in `gone` covers it (all, for a whole copy)."""
    import numpy as np

    n = len(words)
    if n < window or not (whole or gone.is_valid and len(gone)):
        return np.zeros(n, bool)
    if whole:
        return np.ones(n, bool)
    gone = gone.values.to_numpy(zero_copy_only=False)
    w1 = _rolling(_word_hashes(words, memo), window, BASES[0]).view(np.int64)
    starts = np.nonzero(np.isin(w1, gone))[0]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


def _keyed(docs: DataFrame, doc: str = "doc", t1: str = "t1") -> DataFrame:
    """Adds the key of a row: its doc_id as a long, which may be null, and a hash of its text."""
    return docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(t1, F.xxhash64("text"))


def _same_row(left: DataFrame, right: DataFrame):
    return (left["t1"] == right["_t1"]) & left["doc"].eqNullSafe(right["_doc"])


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(_doc, _t1, gone, whole): for each row's key the hashes of its windows that also start in a document with a smaller doc.

    docs(doc, t1, text), where t1 is a hash of text; a null doc comes after all ids and takes nothing from other
    nulls. 0: a text, word for word the same, that a smaller doc has is `whole`: all its windows are repeats, and
    none is the first. 1: find the anchors that different texts have. Two runs of 50 equal words
    share an anchor at the same shift, as the cover has a shift at which both start on a cover
    position; so unshared anchors can go. 2: the shared ones, by text, for the row of its smallest doc. 3: extend
    them to all windows that hold one, and compare these whole (128 bits of hash). Anchors are taken once and written.
    Sums run partly before each shuffle, so a passage in a third of all documents costs a row a task; joins are on
    written tables, so that Spark can split a key with very many rows.
    """
    texts = scratch.save(docs.select("doc", "t1", F.xxhash64(F.lit(7), "text").alias("t2")), "texts")
    owner = scratch.save(texts.groupBy("t1", "t2").agg(F.min("doc").alias("owner")), "owner")
    copies = texts.join(owner, ["t1", "t2"]).where("owner is not null and (doc is null or owner < doc)")
    copies = scratch.save(copies.select("doc", "t1").distinct(), "copies")
    anchors = scratch.save(_anchors(docs, window), "anchors")
    hot = anchors.groupBy("h").agg(F.min("t1").alias("low"), F.max("t1").alias("high")).where("low < high")
    hot = scratch.save(hot.select("h"), "hot")
    scratch.release()
    shared = anchors.join(hot, "h").groupBy(F.col("t1").alias("_t1")).agg(F.collect_set("h").alias("shared"))
    shared = scratch.save(shared.join(owner.select(F.col("t1").alias("_t1"), F.col("owner").alias("_doc")), "_t1"), "shared")
    scratch.drop("anchors")
    scratch.release()
    windows = scratch.save(_candidate_windows(docs.join(shared, _same_row(docs, shared)), window), "windows")
    scratch.release()
    sizes = [F.min("doc").alias("first"), F.max("doc").alias("last"), F.count_if(F.col("doc").isNull()).alias("without")]
    first = windows.groupBy("w1", "w2").agg(*sizes).where("first < last or first is not null and without > 0")
    first = scratch.save(first.select("w1", "w2", "first"), "first")
    scratch.release()
    late = windows.join(first, ["w1", "w2"]).where("first < doc or doc is null")
    gone = late.groupBy(F.col("doc").alias("_doc"), F.col("t1").alias("_t1")).agg(F.collect_set("w1").alias("gone")).withColumn("whole", F.lit(False))
    whole = copies.select(F.col("doc").alias("_doc"), F.col("t1").alias("_t1"), F.lit(None).cast("array<long>").alias("gone"), F.lit(True).alias("whole"))
    gone = scratch.save(gone.unionByName(whole), "gone")
    for name in ("texts", "owner", "copies", "hot", "shared", "windows", "first"):
        scratch.drop(name)
    scratch.release()
    return gone


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for every row of docs(doc_id, text, ...).

    A word goes if a window of `window` consecutive words covers it whose word sequence also starts in
    a document with a smaller doc_id; windows are judged on the input. Null and empty texts have no
    words; texts of fewer words than a window stay whole. Rows without a doc_id count as the
    largest id. Rows that repeat a doc_id are one document to each other: they take nothing from one
    another. kept_text joins the kept words by one space; it is null where nothing was removed (the
    text is then as it was). Further columns are not read.
    """
    scratch = Scratch(spark, "substring")
    base = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    gone = repeated_windows(base, window, scratch)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        memo: dict[bytes, int] = {}
        for b in slices(batches):
            n_words, n_removed, sha, kept_text = [], [], [], []
            for text, gone, whole in zip(texts_of(b), b.column("gone"), b.column("whole").to_pylist()):
                words = text.split() if text else []
                cut = _removed(words, gone, whole, window, memo)
                total = int(cut.sum())
                kept = b" ".join([w for w, x in zip(words, cut) if not x] if total else words)
                n_words.append(len(words))
                n_removed.append(total)
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode("utf-8", "replace") if total else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    joined = base.join(gone, _same_row(base, gone), "left").select(F.col("doc").alias("doc_id"), "text", "gone", "whole")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def cut_repeats(spark: SparkSession, docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the repeated passages cut out of their texts, all columns kept; a text left without words goes.

    n_chars, where there is one, is counted anew for texts that changed.
    """
    scratch = Scratch(spark, "cut")
    key, hashed, cut, all_ = (unused(docs, x) for x in ("_key", "_hashed", "_gone", "_whole"))
    base = _keyed(docs, key, hashed)
    gone = repeated_windows(base.select(F.col(key).alias("doc"), F.col(hashed).alias("t1"), "text"), window, scratch)
    gone = gone.select("_doc", "_t1", F.col("gone").alias(cut), F.col("whole").alias(all_))
    joined = base.join(gone, (base[hashed] == gone["_t1"]) & base[key].eqNullSafe(gone["_doc"]), "left").select(*[base[c] for c in docs.columns], cut, all_)
    fields = docs.schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo: dict[bytes, int] = {}
        for b in slices(batches):
            texts, keep = [], []
            for text, gone, whole in zip(texts_of(b), b.column(cut), b.column(all_).to_pylist()):
                words = text.split() if text and whole is not None else []
                flags = _removed(words, gone, whole, window, memo)
                if flags.any():
                    kept = [w for w, x in zip(words, flags) if not x]
                    texts.append(b" ".join(kept).decode("utf-8", "replace"))
                    keep.append(bool(kept))
                else:
                    texts.append(None if text is None else text.decode("utf-8", "replace"))
                    keep.append(True)
            new = pa.array(texts, b.column("text").type)
            columns = [new if f.name == "text" else b.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields]).filter(pa.array(keep))

    out = joined.mapInArrow(run, fields)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
