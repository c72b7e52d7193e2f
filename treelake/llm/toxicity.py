"""Toxicity: restore disguised words by a noisy-channel decoder, then score the restored text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, as_batch, first_by_hash, held_out, slices

#: Letters that digits and signs stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "", "#": "h"}
#: Natural log costs of the channel: a letter written as a sign; a sign that stands for none, of those that can stand for a
#: letter, and of others; the former as punctuation around a plain word, and after one that holds signs inside; a letter
#: repeated; a double letter that was one; a word end between lone letters.
COST_SIGN, COST_NOISE, COST_MARK, COST_EDGE, COST_RIM, COST_REPEAT, COST_DOUBLE, COST_SPACE = 2.0, 12.0, 1.0, 0.5, 6.0, 1.0, 6.0, 3.0
CLASSES = 28  # 0: between words, 1-26: a-z, 27: any other letter
LETTER = re.compile(r"[^\W\d_]")
TWICE = re.compile(r"([^\W\d_])\1")
PUNCTUATION = "!|+(*#"


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class CharModel:
    """Character trigrams with interpolation; costs are negative natural logs."""

    def __init__(self, counts):
        import numpy as np

        tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        uni = (uni + 1) / (uni.sum() + CLASSES)
        bi = (bi + 4 * uni) / (bi.sum(1, keepdims=True) + 4)
        tri = (tri + 4 * bi[None]) / (tri.sum(2, keepdims=True) + 4)
        self.cost = (-np.log(tri)).tolist()


def char_counts(spark: SparkSession, docs: DataFrame):
    """Trigram counts over the letters of all texts, summed in each task and then by trigram (at most 28^3 rows)."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        table = np.zeros(0x250, np.int32)
        for i in range(len(table)):
            table[i] = _class(chr(i).lower()[0])
        total = np.zeros(CLASSES**3, np.int64)
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                if not text:
                    continue
                for at in range(0, len(text), 1 << 20):
                    code = np.frombuffer((" " + text[max(0, at - 2) : at + (1 << 20)] + " ").encode("utf-32-le", "replace"), np.uint32)
                    c = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], 0)
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=len(total))
        code = np.nonzero(total)[0]
        yield as_batch("code int, n long", code, total[code])

    rows = docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3, np.int64)
    for r in rows:
        counts[r.code] = r.n
    return counts


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character of a lower-cased token: what it may stand for, and at which cost.

    Letters stay, but a letter in a row may have been one or two. Signs and digits stand for letters or for none.
    Punctuation at an edge is cheaply nothing around a plain word; the signs of a token without any letter are letters.
    """
    runs, i = [], 0
    while i < len(token):
        j = i
        while j < len(token) and token[j] == token[i]:
            j += 1
        runs.append((token[i], j - i))
        i = j
    lettered = any(LETTER.match(c) for c, _ in runs)
    plain = lettered and all(LETTER.match(c) or c not in LEET for c, _ in runs[1:-1])
    out = []
    for at, (c, n) in enumerate(runs):
        edge = at in (0, len(runs) - 1)
        if LETTER.match(c):
            out.append([(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, COST_DOUBLE)] if n == 2 else [(c, 0.0), (c + c, COST_REPEAT)])
            continue
        own = LEET.get(c, "")
        if not own:
            out.append([("", COST_MARK)])
            continue
        signs = [(x * min(n, 2), COST_SIGN) for x in own] + ([(x, COST_SIGN + (COST_DOUBLE if n == 2 else COST_REPEAT)) for x in own] if n > 1 else [])
        none = COST_EDGE if edge and plain else COST_RIM if at == len(runs) - 1 and c in PUNCTUATION or c == "(" else COST_NOISE if lettered else None
        out.append(signs if none is None else [("", none), *signs])
    return out


class Restorer:
    """Undoes leetspeak, letters set apart and letters repeated."""

    def __init__(self, model: CharModel):
        self.cost, self.memo = model.cost, {}

    def decode(self, steps: Iterable[list[tuple[str, float]]], spaced: bool = False) -> Iterator[str]:
        """The words of the cheapest path through a lattice of any length: Viterbi, states are the last two letter classes.

        What all paths of the beam share at their beginning is decided and leaves the beam, so its texts stay short.
        """
        cost, beam, rest = self.cost, {(0, 0): (0.0, "")}, ""
        for n, options in enumerate(chain(steps, [[(" ", 0.0)]]), 1):
            after: dict = {}
            for (p, q), (total, text) in beam.items():
                starts = [(p, q, total, text)]
                if spaced and q:  # between two lone letters a word may end
                    starts.append((q, 0, total + COST_SPACE + cost[p][q][0], text + " "))
                for p0, q0, t0, s0 in starts:
                    for out, extra in options:
                        a, b, t = p0, q0, t0 + extra
                        for ch in out:
                            k = _class(ch)
                            t += cost[a][b][k]
                            a, b = b, k
                        if (a, b) not in after or t < after[a, b][0]:
                            after[a, b] = (t, s0 + out)
            beam = after
            if not n % 256:
                sure = len(commonprefix([text for _, text in beam.values()]))
                *whole, rest = (rest + next(iter(beam.values()))[1][:sure]).split(" ")
                yield from filter(None, whole)
                beam = {k: (t, text[sure:]) for k, (t, text) in beam.items()}
        yield from (rest + min(beam.values())[1]).split()

    def word(self, token: str) -> tuple[str, ...]:
        """The restored words of one lower-cased token."""
        known = self.memo.get(token)
        if known is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            known = self._word(token)
            if len(token) <= 256:
                self.memo[token] = known
        return known

    def _word(self, token: str) -> tuple[str, ...]:
        low, high = 0, len(token)
        while low < high and not token[low].isalnum() and token[low] not in LEET:  # never a letter
            low += 1
        while low < high and not token[high - 1].isalnum() and token[high - 1] not in LEET:
            high -= 1
        core = token[low:high]
        if not core or core.isalpha() and not TWICE.search(core):
            return (core,) if core else ()
        return tuple(self.decode(lattice(core)))

    def words(self, text: str | None) -> set[str]:
        """The set of restored words of a whole text; lone letters in a row are read as words set apart."""
        if not text:
            return set()
        found, apart = set(), []
        tokens = text.lower().split()
        memo = self.memo
        if any(len(t) == 1 for t in set(tokens)):
            for t in tokens + [""]:
                if len(t) == 1 and (t.isalnum() or t in LEET):
                    apart.append(t)
                    continue
                if len(apart) >= 3 and len(set(apart)) >= 2:
                    found.update(self.decode(lattice("".join(apart)), spaced=True))
                apart = []
        for t in set(tokens):
            known = memo.get(t)
            found.update(self.word(t) if known is None else known)
        return found


def word_features(word: str) -> list[str]:
    """The word itself, and its first four, five and six letters."""
    return ["=" + word] + ["^" + word[:n] for n in (4, 5, 6) if len(word) >= n]


class ToxicityModel:
    """Logistic regression over the presence of features of restored words."""

    def __init__(self, chars: CharModel, weights: dict[str, float], bias: float):
        self.chars, self.weights, self.bias = chars, weights, bias

    def scorer(self):
        restore, adds = Restorer(self.chars), {}

        def score(text: str | None) -> float:
            if len(adds) > 300_000:
                adds.clear()
            hit = set()
            for w in restore.words(text):
                known = adds.get(w)
                if known is None:
                    known = adds[w] = tuple(f for f in word_features(w) if f in self.weights)
                if known:
                    hit.update(known)
            z = self.bias + sum(self.weights[f] for f in sorted(hit))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def fit_weights(sample: list[tuple[list[int], int]], n_features: int, prior: float, epochs: int = 200, rate: float = 0.5, shrink: float = 1e-3):
    """(weights, bias) by gradient descent over a sample of (feature numbers, label); weights never fall below 0."""
    import numpy as np

    if not sample or len({y for _, y in sample}) < 2:
        return np.zeros(n_features), math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    doc = np.repeat(np.arange(len(sample)), [len(x) for x, _ in sample])
    feature = np.array([f for x, _ in sample for f in x], np.int64)
    y = np.array([t for _, t in sample], float)
    w, b, gw2, gb2 = np.zeros(n_features), -2.0, np.full(n_features, 1e-6), 1e-6
    for _ in range(epochs):
        z = b + np.bincount(doc, w[feature], minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        gw = np.bincount(feature, g[doc], minlength=n_features) + shrink * w / len(y)
        gw2, gb2 = gw2 + gw**2, gb2 + g.sum() ** 2
        w = np.maximum(w - rate * gw / np.sqrt(gw2), 0.0)
        b -= rate * g.sum() / math.sqrt(gb2)
    return w, b


def train_toxicity_model(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_label: int = 2_000, least: int = 3) -> ToxicityModel:
    """Fit the scorer. The character model counts all documents; labels come from a bounded sample.

    The sample: of documents whose crc32(doc_id as text) mod 5 is not 0, at most `per_label` of each
    label, the first by a hash of doc_id; of an id in several rows the least text. Features in at least `least`
    toxic documents whose share among toxic documents is ten times that among the others are kept, all of them:
    per_label alone bounds the fit.
    """
    counts = char_counts(spark, docs)
    chars = CharModel(counts)
    chars_b = spark.sparkContext.broadcast(chars)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"), 5, 0))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = F.broadcast(first_by_hash(marked, "toxic", per_label))  # at most 2 * per_label rows
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id")
    sample = sample.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).repartition(64, "doc_id")  # decoded in many tasks

    def run(batches: Iterator) -> Iterator:
        restore = Restorer(chars_b.value)
        for b in slices(batches):
            features = [sorted({f for w in restore.words(t) for f in word_features(w)}) for t in b.column("text").to_pylist()]
            yield as_batch(kinds, b.column("doc_id"), features, b.column("toxic"))

    kinds = "doc_id long, features array<string>, toxic int"

    scratch = Scratch(spark, "toxic")
    seen = scratch.save(sample.mapInArrow(run, kinds), "sample")
    totals = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    by = seen.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("k1"), F.sum(1 - F.col("toxic")).alias("k0"))
    strong = by.where((F.col("k1") >= least) & (F.col("k1") * max(n0, 1) >= 10 * (F.col("k0") + 0.1) * max(n1, 1)))
    chosen = [r.f for r in strong.orderBy(F.desc("k1"), "f").collect()]
    number = {f: i for i, f in enumerate(chosen)}
    keep = F.array_intersect("features", F.lit(chosen) if chosen else F.array().cast("array<string>"))
    data = [([number[f] for f in r.features], r.toxic) for r in seen.select("doc_id", keep.alias("features"), "toxic").orderBy("doc_id").collect()]
    weights, bias = fit_weights(data, len(chosen), n1 / max(n1 + n0, 1))
    return ToxicityModel(chars, {f: float(weights[i]) for f, i in number.items() if weights[i] > 0}, float(bias))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text, ...).

    score is the probability of toxicity of the restored text; predicted is 1 from 0.5 on. Null and
    empty texts get the score of a text without any feature. With labels of one kind alone, or none,
    every score is that kind's share. Tokens are decoded whole, whatever their length. Rows without a doc_id count as held out. labels(doc_id,
    toxic): rows with nulls or other values are no labels; an id marked twice counts as toxic if
    either mark is. lang, source and further columns are not read. Repeated rows come back as given.
    """
    model_b = spark.sparkContext.broadcast(train_toxicity_model(spark, docs, labels))

    def run(batches: Iterator) -> Iterator:
        score = model_b.value.scorer()
        for b in slices(batches):
            yield as_batch("doc_id long, score double", b.column("doc_id"), [score(t) for t in b.column("text").to_pylist()])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
