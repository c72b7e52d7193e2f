"""Language ID: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, as_batch, first_by_hash, give_back, held_out, slices, store_of

UNKNOWN = "und"
BUCKET_BITS = 15  # 16 at most


@lru_cache(1)
def _letters():
    """Whether each code point is a letter."""
    import numpy as np

    return np.array([chr(c).isalpha() for c in range(0x110000)])


def subwords(text: str | None):
    """Hash buckets of the 1- to 4-grams of characters of a text's words, as one array.

    Words are runs of letters, lower-cased, with their two ends marked. Empty without a letter.
    """
    import numpy as np

    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one mark after each word
    c = np.concatenate([[0], np.where(letter, code, 0)[keep], [0]]).astype(np.uint32)
    end, x, g, out = c == 0, c * np.uint32(0x9E3779B1), None, []
    for n in range(1, 5):
        g = x if g is None else g[:-1] * np.uint32(0x01000193) + x[n - 1 :]
        inner = ~end if n == 1 else ~(end[:-1] & end[1:]) if n == 2 else ~end[1:-1] if n == 3 else ~(end[1:-2] | end[2:-1])
        h = g[inner] + np.uint32(n)
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out).astype(np.int64)


def out_of_language(text: str, rng, letters: list[str]) -> tuple[str, str]:
    """Two texts in no language: the letters of a text's words dealt anew, and its letters swapped by a random cipher."""
    place = [i for i, c in enumerate(text) if c.isalpha()]
    mixed = list(text)
    for i, j in zip(place, rng.permutation(len(place)) if place else []):
        mixed[i] = text[place[j]]
    return "".join(mixed), text.lower().translate(str.maketrans(dict(zip(letters, rng.permutation(letters))))) if letters else text


class LanguageModel:
    """label = softmax(temperature * (mean of subword embeddings @ weights + bias)) over the labels and one class for anything else."""

    def __init__(self, labels: list[str], dim: int = 16, seed: int = 4):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim)).astype("float32")
        self.out = np.zeros((dim, len(labels) + 1), "float32")
        self.bias = np.zeros(len(labels) + 1, "float32")
        self.temperature, self.thresholds = 1.0, [0.0] * len(labels)

    def features(self, text: str):
        """The different buckets of a text and their shares."""
        import numpy as np

        index, n = np.unique(subwords(text), return_counts=True)
        return index, (n / max(n.sum(), 1)).astype("float32")

    def logits(self, x):
        index, weight = x
        return (weight @ self.embed[index]) @ self.out + self.bias

    def fit(self, data: list[tuple], epochs: int = 6, rate: float = 4.0, seed: int = 4) -> None:
        """Plain stochastic gradient descent over (features, class), one example at a time, with a linearly falling rate."""
        import numpy as np

        rng = np.random.default_rng(seed)
        steps, done = epochs * len(data), 0
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                (index, weight), y = data[i]
                lr = rate * (1 - done / steps)
                done += 1
                hidden = weight @ self.embed[index]
                z = hidden @ self.out + self.bias
                g = np.exp(z - z.max())
                g /= g.sum()
                g[y] -= 1
                back = self.out @ g
                self.out -= lr * 0.1 * np.outer(hidden, g)
                self.bias -= lr * 0.01 * g
                self.embed[index] -= lr * weight[:, None] * back[None, :]

    def shares(self, features: list):
        """Probabilities of all classes for each of a list of features."""
        import numpy as np

        z = np.array([self.logits(x) for x in features]).reshape(-1, len(self.labels) + 1) * self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def calibrate(self, held: list[tuple], strangers: list[tuple[int, float]], weight: float = 20.0) -> None:
        """Pick the temperature of least log loss on held-back (features, class), then a threshold for each label.

        strangers: (label, score) that texts in no learned language got. A label's threshold costs `weight` times
        the share of its own rightly labelled texts that it rejects and once the share of strangers that it lets
        pass; the least cost decides, then the lowest threshold.
        """
        import numpy as np

        if not held:
            return
        y = np.array([t for _, t in held])

        def log_loss(t):
            self.temperature = t
            return float(-np.log(self.shares([x for x, _ in held])[np.arange(len(y)), y] + 1e-30).mean())

        self.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0), key=log_loss)
        own = self.shares([x for x, c in held if c < len(self.labels)])[:, :-1]
        true = y[y < len(self.labels)]
        strangers = strangers + self.best([x for x, c in held if c == len(self.labels)])
        for k in range(len(self.labels)):
            good = np.sort(own[(true == k) & (own.argmax(1) == k), k])
            bad = np.sort([s for label, s in strangers if label == k])
            if len(good) and len(bad):
                tries = np.concatenate([[0.0], good, bad + 1e-9])
                cost = weight * np.searchsorted(good, tries) / len(good) + 1 - np.searchsorted(bad, tries) / len(bad)
                self.thresholds[k] = float(tries[np.lexsort((tries, cost))[0]])

    def best(self, features: list) -> list[tuple[int, float]]:
        """The likeliest label and its score for each of a list of features."""
        p = self.shares(features)[:, :-1]
        return [(int(k), float(x[k])) for k, x in zip(p.argmax(1), p)]

    def scorer(self):
        """A function text -> (label, score, rejected). Embeddings and weights are multiplied out once, so a text costs one
        table row a subword; very long texts go in pieces of a million characters."""
        import numpy as np

        table, piece = self.embed @ self.out, 1 << 20

        def score(text: str | None) -> tuple[str, float, bool]:
            z, n = np.zeros(len(self.labels) + 1), 0
            for begin in range(0, len(text or ""), piece):
                index = subwords(text[begin : begin + piece])
                z, n = z + table[index].sum(0, dtype="float64"), n + len(index)
            if not n or not self.labels:
                return UNKNOWN, 0.0, True
            z = (z / n + self.bias) * self.temperature
            p = np.exp(z - z.max())
            k = int(p[:-1].argmax())
            share = float(p[k] / p.sum())
            return self.labels[k], share, share < self.thresholds[k]

        return score


def labelled_sample(docs: DataFrame, per_label: int, most: int) -> DataFrame:
    """(doc_id, lang, text): whole texts of at most `per_label` documents of each language, fewer if all languages
    together would exceed `most`, one of each at least. The first by a hash of doc_id; of an id in several rows the least text counts."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), 3, 1))
    n = known.select("lang").distinct().count()
    picked = F.broadcast(first_by_hash(known.select("doc_id", "lang"), "lang", min(per_label, max(1, most // max(n, 1)))))  # at most `most` rows
    return known.join(picked, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def _examples(sample: DataFrame, letters: list[str]) -> DataFrame:
    """(doc_id, lang, part, bucket, share) of a sample: bucket shares of a whole text (part 0), of a short stretch of it (1), and
    for half of the ids of two texts in no language made of it (2, 3). A row has no more than all buckets."""
    seen = sample.sparkSession.sparkContext.broadcast(letters)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        features = LanguageModel([]).features
        for b in slices(batches, 64):
            rows = []
            for doc, lang, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                rng = np.random.default_rng([4, doc & ((1 << 63) - 1)])
                words, n = text.split(), int(rng.integers(1, 13))
                at = int(rng.integers(0, max(1, len(words) - n + 1)))
                parts = [text, " ".join(words[at : at + n]), *(out_of_language(text, rng, seen.value) if rng.random() < 0.5 else ())]
                rows += [(doc, lang, k, *features(x)) for k, x in enumerate(parts)]
            rows = [(*r[:3], r[3].astype("<u2").tobytes(), r[4].astype("<f4").tobytes()) for r in rows if len(r[3])]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "lang", "part", "bucket", "share"])

    return sample.mapInArrow(run, "doc_id long, lang string, part int, bucket binary, share binary")


class Examples:
    """The table of `_examples` in the shared folder, as tasks read it, and the split of its documents: a fifth is held back."""

    def __init__(self, path: str, labels: list[str]):
        self.path, self.labels = path, labels

    def read(self) -> tuple[list, list]:
        """(train, held): lists of (features, class), in the order of doc_id, lang and part."""
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        store, top = store_of(self.path)
        rows = []
        for f in sorted(store.get_file_info(fs.FileSelector(top)), key=lambda f: f.path):
            if f.path.endswith(".parquet"):
                with store.open_input_file(f.path) as file:
                    t = pq.read_table(file)
                rows += zip(*(t.column(c).to_pylist() for c in ("doc_id", "lang", "part", "bucket", "share")))
                del t
                give_back()
        rows.sort(key=lambda r: r[:3])
        place = {key: i for i, key in enumerate(sorted({r[:2] for r in rows}))}
        train, held = [], []
        for doc, lang, part, bucket, share in rows:
            i, x = place[doc, lang], _arrays(bucket, share)
            y = self.labels.index(lang) if part < 2 else len(self.labels)
            if i % 5:
                train.append((x, y))
            elif part != 1:
                held.append((x, y))
        return train, held


def _fitted(spark: SparkSession, examples: Examples) -> LanguageModel:
    """The model, fitted in one task, and beside it a model without each language in a task of its own, which scores held-back
    texts of that language; a last task calibrates by these. The driver gets the model's numbers alone."""
    labels = examples.labels

    def fit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            for k in b.column("k").to_pylist():
                train, held = examples.read()
                model = LanguageModel(labels)
                if k < 0:
                    model.fit(train)
                    found = model
                else:
                    model.fit([(x, y) for x, y in train if y != k], epochs=2)
                    found = model.best([x for x, y in held if y == k])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(found)])], ["k", "found"])

    first = -1
    last = len(labels) if len(labels) > 1 else 0
    tasks = spark.range(first, last, 1, last - first).select(F.col("id").cast("int").alias("k"))
    rows = sorted(tasks.mapInArrow(fit, "k int, found binary").collect(), key=lambda r: r.k)  # a row a language
    model = pickle.loads(rows[0].found)
    # as rows of (language left out, label, score), sorted
    strangers = [(label, score) for _, label, score in sorted((r.k, label, score) for r in rows[1:] for label, score in pickle.loads(r.found))]
    shipped = spark.sparkContext.broadcast((model, strangers))

    def calibrate(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            if b.num_rows:
                model, strangers = shipped.value
                model.calibrate(examples.read()[1], strangers)
                yield pa.RecordBatch.from_arrays([pa.array([float(model.temperature)]), pa.array([[float(x) for x in model.thresholds]], pa.list_(pa.float64()))], ["temperature", "thresholds"])

    one = spark.range(0, 1, 1, 1).mapInArrow(calibrate, "temperature double, thresholds array<double>").first()
    shipped.destroy()
    model.temperature, model.thresholds = one.temperature, list(one.thresholds)
    return model


def train_language_model(spark: SparkSession, docs: DataFrame, per_label: int = 600, most: int = 6_000) -> LanguageModel:
    """Fit on the whole texts of `labelled_sample`, whose rows these parameters bound; tasks turn them into bucket shares.

    Documents whose crc32(doc_id as text) mod 3 is 1, or without id, lang or letters, are no part of it. Each text is
    joined by a short stretch of itself, so that short texts are known as well, and half of them by texts in no
    language. A fifth of the sample is held back to calibrate; so are, for each language, the scores that a model without it
    gives to its texts. Models are fitted in tasks, which read bucket shares, 6 bytes a bucket, from the shared folder: the driver gets no texts and no features.
    """
    scratch = Scratch(spark, "langid")
    sample = scratch.save(labelled_sample(docs, per_label, most).where(F.regexp_like("text", F.lit(r"\p{L}"))).repartition(32, "doc_id"), "sample")
    labels = [r.lang for r in sample.select("lang").distinct().orderBy("lang").collect()]
    if not labels:
        return LanguageModel(labels)
    letters = sample.select(F.explode(F.array_distinct(F.split(F.lower("text"), ""))).alias("c")).where(F.regexp_like("c", F.lit(r"^\p{L}$"))).distinct()
    letters = sorted(r.c for r in letters.collect())  # of one alphabet or some
    scratch.save(_examples(sample, letters), "examples")
    return _fitted(spark, Examples(f"{scratch.path}/examples", labels))


def _arrays(bucket: bytes, share: bytes) -> tuple:
    import numpy as np

    return np.frombuffer(bucket, "<u2"), np.frombuffer(share, "<f4")


def predict_language(spark: SparkSession, docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs(doc_id, text, lang, ...).

    lang_pred is the likeliest learned language and score its calibrated probability. Null texts and texts
    without a letter, and all texts where there was nothing to learn from, are `und` with score 0.
    rejected: `und`, or a score below the label's threshold. Ties go to the first label by name. Whole texts are read; lang only to learn.
    Rows without a doc_id count as held out. Repeated rows come back as given.
    """
    model = model or train_language_model(spark, docs)
    model_b = spark.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        model = model_b.value
        score = model.scorer()
        for b in slices(batches):
            found = [score(t) for t in b.column("text").to_pylist()]
            yield as_batch(kinds, b.column("doc_id"), *([f[i] for f in found] for i in range(3)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, lang_pred string, score double, rejected boolean"
    out = rows.mapInArrow(run, kinds)
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known_languages(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, with all their columns.

    Null texts and texts without a letter go; rows that repeat stay or go together; rows without a doc_id are
    judged like others; an empty table, or one without any labelled document, keeps nothing. Very long texts are read whole.
    """
    model = train_language_model(spark, docs)
    model_b = spark.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = model_b.value
        score = model.scorer()
        for b in slices(batches):
            yield b.filter(pa.array([not score(t)[2] for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
