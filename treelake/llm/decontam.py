"""Benchmark decontamination: BM25 over the test items, searched by every training passage with block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, as_batch, slices, store_of, unused

WORDS = re.compile(r"[^\W_]+")
SHINGLE, SIMILAR = 5, 0.8
#: Bytes of texts that a task holds as words, and how many different words of them before it goes on with these.
TEXT_BYTES, VOCABULARY = 8 << 20, 100_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return WORDS.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item's question and answer: the answer is what follows the last inner sentence end.

    An item of one sentence is split after two thirds of its words.
    """
    parts = re.split(r"(?<=[.?!])\s+", text.strip())
    words = words_of(text)
    tail = words_of(parts[-1]) if len(parts) > 1 else []
    n = len(tail) if 0 < len(tail) < len(words) else max(1, len(words) // 3)
    return words[:-n], words[-n:]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


class Index:
    """An inverted index of one shard of the items, under statistics of all of them.

    Impacts are BM25 term scores as a share of the item's score for its own text, so one threshold
    fits all items. Items are ordered by their first word and lie in blocks; for each term the index
    keeps its highest impact in all items, in each block, and the postings. df: in how many of all `n` items
    each term is; mean, longest: words of an item, of all items.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, mean: float, longest: int, block: int = 8, k1: float = 1.2, b: float = 0.75):
        import numpy as np

        kept = sorted(((i, t, words_of(t)) for i, t in items), key=lambda x: (x[2], x[0]))
        self.items = [(i, t) for i, t, _ in kept]
        self.block, self.longest = block, longest
        self.terms = {t: k for k, t in enumerate(sorted({t for _, _, w in kept for t in w}))}
        rows: list[tuple[int, int, float]] = []
        for at, (_, _, w) in enumerate(kept):
            tf = sorted(Counter(w).items())
            raw = [(t, math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (k1 + 1) / (c + k1 * (1 - b + b * len(w) / mean))) for t, c in tf]
            own = math.fsum(x for _, x in raw)
            rows += [(self.terms[t], at, x / own) for t, x in raw]
        rows.sort()
        term = np.array([r[0] for r in rows], np.int64)
        self.post_item = np.array([r[1] for r in rows], np.int64)
        self.post_impact = np.array([r[2] for r in rows], np.float64)
        self.post_at = np.searchsorted(term, np.arange(len(self.terms) + 1))
        # block maxima, in the same layout
        self.n_blocks = len(kept) // block + 1
        key = term * self.n_blocks + self.post_item // block
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        self.block_max = np.maximum.reduceat(self.post_impact, first) if len(rows) else np.zeros(0)
        self.block_no = self.post_item[first] // block if len(rows) else np.zeros(0, np.int64)
        self.block_at = np.searchsorted(term[first] if len(rows) else term, np.arange(len(self.terms) + 1))
        self.bound = np.maximum.reduceat(self.post_impact, self.post_at[:-1]) if len(rows) else np.zeros(0)
        self.parts = [question_and_answer(t) for _, t in self.items]

    @staticmethod
    def _gather(at, terms):
        """Places of the entries of all the terms' lists, and for each which of the terms it belongs to."""
        import numpy as np

        low, n = at[terms], at[terms + 1] - at[terms]
        ends = np.cumsum(n)
        return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - ends + n, n), np.repeat(np.arange(len(terms)), n)

    def search(self, passage, term, n: int, threshold: float) -> list[tuple[int, int, float]]:
        """(passage, item place, score) of all items that score at the threshold or above for one of n passages.

        passage, term: the distinct terms of each passage, as pairs. A passage whose terms' highest
        impacts together stay below the threshold is skipped, and so is every block whose maxima do: the
        pivot test of block-max WAND, taken for the blocks of all passages at once instead of by moving cursors.
        """
        import numpy as np

        low = threshold - 1e-12
        keep = (np.bincount(passage, self.bound[term], n) >= low)[passage]
        passage, term = passage[keep], term[keep]
        if not len(term):
            return []
        e, of = self._gather(self.block_at, term)
        upper = np.bincount(passage[of] * self.n_blocks + self.block_no[e], self.block_max[e], n * self.n_blocks)
        viable = upper >= low
        keep = viable.reshape(n, -1).any(1)[passage]
        passage, term = passage[keep], term[keep]
        if not len(term):
            return []
        p, of = self._gather(self.post_at, term)
        keep = viable[passage[of] * self.n_blocks + self.post_item[p] // self.block]
        p, of = p[keep], of[keep]
        key, back = np.unique(passage[of] * len(self.items) + self.post_item[p], return_inverse=True)
        score = np.bincount(back, self.post_impact[p], len(key))
        return [(int(k) // len(self.items), int(k) % len(self.items), float(x)) for k, x in zip(key, score) if x >= low]

    def passages(self, words: list[str], threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(start, end, item place, score) for each passage of a text and each item that it retrieves.

        Passages are twice as long as the longest item and start at every item length, so that an
        item's words always lie whole in one. They are searched some at a time, in bounded memory.
        """
        import numpy as np

        if not words or not self.items:
            return
        step, size, get = max(self.longest, 16), len(self.terms), self.terms.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        n = max(1, -(-len(words) // step) - 1)
        at_once = max(1, min(256, (1 << 22) // self.n_blocks))
        for first in range(0, n, at_once):
            m = min(at_once, n - first)
            part = ids[first * step : (first + m + 1) * step]
            place = np.arange(len(part)) // step
            known = part >= 0
            # a word lies in the passage that starts in its stretch and in the one before
            pairs = np.concatenate([place[known] * size + part[known], (place[known] - 1) * size + part[known]])
            pairs = np.unique(pairs[(pairs >= 0) & (pairs < m * size)])
            for k, item, score in self.search(pairs // size, pairs % size, m, threshold):
                start = (first + k) * step
                yield start, min(start + 2 * step, len(words)), item, score

    def verify(self, item: int, words: list[str]) -> tuple[float, float]:
        """Shares of the question's and of the answer's five-word shingles that occur in a passage."""
        seen, out = shingles(words), []
        for part in self.parts[item]:
            own = shingles(part)
            if part and len(part) < SHINGLE:  # too short for a shingle: its words in a row
                n, line = len(part), words
                out.append(float(any(line[i : i + n] == part for i in range(len(line) - n + 1))))
            else:
                out.append(len(own & seen) / len(own) if own else 1.0)
        return out[0], out[1]


def write_index(benchmark: DataFrame, shard_bytes: int, scratch: Scratch) -> int:
    """Write the index of all items as shards of about `shard_bytes` of text each below the scratch folder; how many there are.

    Counts of terms, items and lengths are of all items. Shards are built in tasks, each from its items and the
    counts of its own terms.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()

    def split(batches: Iterator) -> Iterator:
        for b in slices(batches):
            words = [words_of(t) for t in b.column("text").to_pylist()]
            yield as_batch(kinds, b.column("item_id"), b.column("text"), [sorted(set(w)) for w in words], [len(w) for w in words])

    kinds = "item_id long, text string, terms array<string>, words long"
    items = scratch.save(items.mapInArrow(split, kinds).where("words > 0"), "items")
    one = items.agg(F.count("*").alias("n"), F.avg("words").alias("mean"), F.max("words").alias("longest"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()
    if not one.n:
        return 0
    shards = -(-one.bytes // shard_bytes)
    items = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    terms = items.select("shard", F.explode("terms").alias("term"))
    df = scratch.save(terms.groupBy("term").agg(F.count("*").alias("df")), "df")
    own = terms.distinct().join(df, "term").select(F.col("shard").alias("asker"), "term", "df")

    def build(items, own):
        import pickle

        import pandas as pd

        index = Index(list(zip(items["item_id"].tolist(), items["text"])), dict(zip(own["term"], own["df"].tolist())), one.n, one.mean, one.longest)
        return pd.DataFrame({"shard": items["shard"].iloc[:1], "index": [pickle.dumps(index)]})

    built = items.select("shard", "item_id", "text").groupBy("shard").cogroup(own.groupBy("asker")).applyInPandas(build, "shard int, index binary")
    built.write.partitionBy("shard").parquet(f"{scratch.path}/index")
    return shards


@lru_cache(2)
def read_shard(folder: str, shard: int) -> Index | None:
    """A shard of the index from the shared folder; None where no item fell to it."""
    import pickle

    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    store, top = store_of(f"{folder}/shard={shard}")
    if store.get_file_info(top).type == fs.FileType.NotFound:
        return None
    return pickle.loads(pq.read_table(top, filesystem=store, columns=["index"]).column("index")[0].as_py())


def _by_bytes(batches: Iterator, size: int, vocabulary: int = VOCABULARY) -> Iterator[list[tuple]]:
    """Rows (doc_id, t1, words) whose texts are about `size` bytes together, or that have about `vocabulary` different words; a
    longer text comes alone. Equal words are one string, so a word costs its place in a list."""
    held, filled, known = [], 0, {}
    for b in slices(batches, 64):
        for doc, t1, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "t1", "text"))):
            held.append((doc, t1, [known.setdefault(w, w) for w in words_of(text)]))
            filled += len(text or "")
            if filled >= size or len(known) >= vocabulary:
                yield held
                held, filled, known = [], 0, {}
    if held:
        yield held


def _found(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float, similar: float, shard_bytes: int) -> DataFrame:
    """(doc_id, t1, item_id, score, question_overlap, answer_overlap, passage_start) of every passage found; t1 is a hash of
    the text of a row without a doc_id."""
    scratch = Scratch(spark, "leaks")
    shards, folder = write_index(benchmark, shard_bytes, scratch), f"{scratch.path}/index"
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64(text)).alias("t1"), text.alias("text"))
    kinds = "doc_id long, t1 long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"

    def run(batches: Iterator) -> Iterator:
        for texts in _by_bytes(batches, TEXT_BYTES):
            out = []
            for index in filter(None, (read_shard(folder, k) for k in range(shards))):
                for doc, t1, words in texts:
                    for start, end, item, score in index.passages(words, threshold):
                        q, a = index.verify(item, words[start:end])
                        if q >= similar and a >= similar:
                            out.append((doc, t1, index.items[item][0], score, q, a, start))
            yield as_batch(kinds, *([r[i] for r in out] for i in range(7)))

    return rows.mapInArrow(run, kinds)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, similar: float = SIMILAR, shard_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_start) of each item found in a document.

    Every passage of every whole text queries the index; items that score `threshold` of their own
    BM25 score or more are retrieved, and stand if `similar` or more of the five-word shingles of both
    question and answer occur in the passage. Of several passages the one of highest score is given, then
    the first. Items or texts that are null, empty or without words match nothing; null doc_ids match
    as null; rows that repeat a doc_id count as one document; very long texts are searched some passages at a
    time. Further columns are not read.

    The index lies in the shared folder in shards of about `shard_bytes` of items. Documents are read and
    split once, TEXT_BYTES of them at a time; each such batch takes the shards one after the other, so a task holds one
    or two, whatever the number of items. Shards decide the memory, never the result.
    """
    found = _found(spark, docs, benchmark, threshold, similar, shard_bytes)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("passage_start")).alias("at"), "question_overlap", "answer_overlap")).alias("m"))
    return best.select("doc_id", "item_id", "m.score", "m.question_overlap", "m.answer_overlap", (-F.col("m.at")).alias("passage_start"))


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, similar: float = SIMILAR) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows of one doc_id stay or go together. A row without a doc_id goes by its own text, and so do others that have
    no doc_id and the same text. Null and empty texts stay; very long ones are read whole; see find_leaks.
    What goes is written first, so that Spark knows its size: where that allows a broadcast, no text is shuffled.
    """
    key, own = unused(docs, "_gone"), unused(docs, "_text")
    gone = _found(spark, docs, benchmark, threshold, similar, 8 << 20).select(F.col("doc_id").alias(key), F.col("t1").alias(own)).distinct()
    gone = Scratch(spark, "leaked").save(gone, "gone")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string"))).eqNullSafe(F.col(own))
    return docs.join(gone, same, "left_anti")
