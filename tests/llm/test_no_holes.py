"""Rows without an id, popular hosts, and classifiers without caps."""

import random

from treelake.llm.decontam import drop_leaks
from treelake.llm.neardup import keep_one_per_group

ITEM = "what is the capital city of the small island nation in the south answer it is the harbour town of port example"


def test_leaks_go_with_or_without_an_id(spark):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    rows = [(1, f"intro words {ITEM} and more", "a"), (None, f"other words {ITEM} here", "b"), (None, f"other words {ITEM} here", "c"), (None, "clean text of no benchmark at all", "d"), (2, "clean text", "e"), (None, None, "f"), (3, None, "g"), (3, ITEM, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    got = drop_leaks(spark, docs, bench)
    assert got.columns == docs.columns and sorted(r[2] for r in got.collect()) == ["d", "e", "f"]
    assert drop_leaks(spark, docs.where("false"), bench).count() == 0


def test_copies_without_an_id_go(spark):
    rng = random.Random(2)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c = text(), text(), text()
    near = lambda t: t + " tail"
    rows = [(5, a, "5a"), (None, a, "na"), (None, near(a), "na2"), (None, b, "nb"), (None, b, "nb2"), (None, near(b), "nb3"), (None, c, "nc"), (7, near(a), "7a"), (9, text(), "9")]
    got = sorted(r.m for r in keep_one_per_group(spark, spark.createDataFrame(rows, "doc_id long, text string, m string")).collect())
    assert len(got) == 4 and {"5a", "9", "nc"} < set(got) and sum(m.startswith("nb") for m in got) == 1


def test_popular_names_are_still_split(spark):
    from treelake.llm.urlfilter import Segmenter, word_counts

    html = "<p>" + " ".join(["best shop cheap"] * 40) + "</p><a href='http://bestshop.net/x'>http://bestshop.net/x</a>"
    pages = spark.createDataFrame([(i, f"http://bestshop{i % 3}.net/bestcheapshop", html) for i in range(300)], "page_id long, url string, html string")
    words = {r.w: r.n for r in word_counts(pages).collect()}
    assert "bestshop" not in words and words["best"] == 300 * 40
    by = Segmenter(words.items(), sum(words.values()))
    assert list(by.split("bestshop")) == ["best", "shop"] and list(by.split("bestcheapshop")) == ["best", "cheap", "shop"]


def test_language_model_reads_whole_texts_of_all_languages(spark):
    """The classifier's first step, its rejection of strangers and its sample, against the definition."""
    import numpy as np

    from treelake.llm import langid

    rng = random.Random(1)
    words = {f"l{k}": ["".join(rng.choice(a) for _ in range(5)) for _ in range(40)] for k, a in enumerate(("abcde", "fghij", "klmno", "pqrst", "uvwxy", "abxyz", "cdmno", "efpqr", "ghstu", "ijvwk"))}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(f"l{i % 10}", 30 + i % 50), f"l{i % 10}") for i in range(400)] + [(900, "12 34", "l0"), (901, None, "l1"), (None, "abc", "l2"), (902, text("l3", 20_000), "l3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.labelled_sample(docs, 10, 10_000).collect()
    sizes = {k: sum(r.lang == k for r in sample) for k in words}
    assert all(n == 10 for n in sizes.values()) and all(r.text == dict((d, t) for d, t, _ in rows)[r.doc_id] for r in sample)
    examples = langid._examples(spark.createDataFrame([(902, "l3", rows[-1][1])], "doc_id long, lang string, text string"), list("abc")).where("part = 0").first()
    index, n = np.unique(langid.subwords(rows[-1][1]), return_counts=True)
    bucket, share = langid._arrays(examples.bucket, examples.share)
    assert bucket.tolist() == index.tolist() and np.allclose(share, n / n.sum())
    model = langid.train_language_model(spark, docs, 40)
    assert model.labels == sorted(words)
    got = langid.predict_language(spark, docs, model).collect()
    right = [(r.lang_pred == f"l{r.doc_id % 10}") and not r.rejected for r in got if r.doc_id is not None and r.doc_id < 900]
    assert sum(right) > 0.95 * len(right)
    strangers = spark.createDataFrame([(i, " ".join("".join(rng.choice("éüößäñ") for _ in range(6)) for _ in range(40)), None) for i in range(20)], "doc_id long, text string, lang string")
    assert sum(r.rejected for r in langid.predict_language(spark, strangers, model).collect()) >= 18


def test_one_step_of_descent_is_the_gradient():
    """SGD's step on one example against differences of its cross entropy."""
    import numpy as np

    from treelake.llm.langid import LanguageModel

    model = LanguageModel(["a", "b"], dim=3)
    rng = np.random.default_rng(0)
    model.embed, model.out, model.bias = rng.normal(size=(1 << 15, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    x, y = (np.array([3, 8, 9]), np.array([0.5, 0.25, 0.25])), 1

    def loss():
        z = model.logits(x)
        return np.log(np.exp(z - z.max()).sum()) + z.max() - z[y]

    want, old = {}, {n: getattr(model, n).copy() for n in ("embed", "out", "bias")}
    for name, at in (("embed", (8, 1)), ("out", (2, 0)), ("bias", (1,))):
        a, h = getattr(model, name), 1e-6
        a[at] += h
        up = loss()
        a[at] -= 2 * h
        want[name, at] = (up - loss()) / (2 * h)
        a[at] += h
    model.fit([(x, y)], epochs=1, rate=1e-3)
    for (name, at), g in want.items():
        assert np.isclose((old[name][at] - getattr(model, name)[at]) / {"embed": 1e-3, "out": 1e-4, "bias": 1e-5}[name], g, rtol=1e-4)
