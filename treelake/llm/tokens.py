"""Token counts by a map-side table of pre-token lengths; pre-tokens are never shuffled."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import as_batch, slices

#: Fixed value: the pre-token pattern of the byte-level tokenizer files.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes every Unicode version agrees on; a text with any other goes to the library whole.
PLAIN = r"[\t\n\r\x20-\x7E¡-¬®-ȳΑ-ΡΣ-ώА-я‐-‧‰-⁞€]*"


def tokenizer_file(path: str | None = None) -> str:
    """The text of a tokenizer's .json file; by default that of byte_bpe_50k.json."""
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def refuse_other_splits(model: str) -> None:
    """Raise unless the file's pre-tokenizer is the byte-level one with its own pattern and nothing rewrites texts before it."""
    spec = json.loads(model)
    split = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("this tokenizer splits texts in another way than PRE_TOKEN")


class Lengths:
    """Token counts of texts in one worker: the shared table first, then a bounded cache, then the tokenizer."""

    def __init__(self, model: str, frequent: dict[str, int], cache: int = 200_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find, self.plain = regex.compile(PRE_TOKEN), regex.compile(PLAIN)
        self.frequent, self.misses, self.cache = frequent, {}, cache

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def is_plain(self, text: str) -> bool:
        return self.plain.fullmatch(text) is not None and not any(s in text for s in self.special)

    def count(self, text: str) -> int:
        if not self.is_plain(text):
            return self.whole(text)
        known = self.frequent.get
        if len(text) > 1 << 20:  # stream the matches of a very long text instead of listing them
            return sum(known(m[0]) or self.miss(m[0]) for m in self.find.finditer(text))
        found = self.find.findall(text)
        lengths = list(map(known, found))
        if None in lengths:
            return sum(self.miss(w) if k is None else k for w, k in zip(found, lengths))
        return sum(lengths)

    def miss(self, pre: str) -> int:
        n = self.misses.get(pre)
        if n is None:
            if len(self.misses) >= self.cache:
                self.misses.clear()
            n = self.misses[pre] = self.whole(pre)
        return n


def vocabulary_lengths(model: str) -> dict[str, int]:
    """Lengths of those entries of the tokenizer's vocabulary that are pre-tokens: what was frequent where it was trained."""
    at = Lengths(model, {})
    entries = at.tokenizer.decode_batch([[i] for i in at.tokenizer.get_vocab().values()], skip_special_tokens=False)
    whole = [x for x in set(entries) if x and at.is_plain(x) and at.find.fullmatch(x)]
    return dict(zip(whole, map(len, at.tokenizer.encode_batch(whole, add_special_tokens=False))))


@lru_cache(2)
def _worker(model: str) -> Lengths:
    """One tokenizer and one cache for all tasks of a worker."""
    return Lengths(model, {})


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text, ...).

    n_tokens is what the tokenizer at `path` gives for the whole text, without added special tokens;
    special strings in a text count as the library reads them by default. Null and empty texts have 0
    bytes and 0 tokens; texts of any length are read whole. Null doc_ids and repeated rows come back as
    given; further columns are not read. A tokenizer that doesn't split texts as PRE_TOKEN does is refused.

    Tier one is a broadcast table of the lengths of the vocabulary's own entries, which bounds it; tier
    two is each worker's own cache of the rest. Nothing is shuffled. The tables decide the speed, never the result.
    """
    model = tokenizer_file(path)
    refuse_other_splits(model)
    tier_b = spark.sparkContext.broadcast((model, vocabulary_lengths(model)))

    def run(batches: Iterator) -> Iterator:
        model, table = tier_b.value
        at = _worker(model)
        at.frequent = table
        for b in slices(batches):
            yield as_batch(kinds, b.column("doc_id"), b.column("n_bytes"), [at.count(t) for t in b.column("text").to_pylist()])

    kinds = "doc_id long, n_bytes long, n_tokens long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInArrow(run, kinds)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
