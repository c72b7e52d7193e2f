"""Methods inside the operators against enumeration and independent formulas."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def restorer(spark):
    from treelake.llm.toxicity import CharModel, Restorer, char_counts

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    more = spark.createDataFrame([("you are an idiot and a stupid loser, pathetic trash and shit " * 20,)] * 20, "text string")
    return Restorer(CharModel(char_counts(spark, docs.unionByName(more))))


def test_viterbi_equals_enumeration(restorer):
    from treelake.llm.toxicity import COST_SPACE, _class, lattice

    def cost(text):
        a, b, t = 0, 0, 0.0
        for c in text:
            k = _class(c)
            t += restorer.cost[a][b][k]
            a, b = (b, k) if c != "|" else (0, 0)
        return t

    rng = random.Random(2)
    for _ in range(150):
        token = "".join(rng.choice("abdiot1045!@$#.") for _ in range(rng.randint(1, 7)))
        best = {}
        for path in itertools.product(*lattice(token)):
            text = "".join(x for x, _ in path)
            best[text] = min(best.get(text, math.inf), sum(c for _, c in path) + cost(text + " "))
        got = "".join(restorer.decode(lattice(token)))
        assert best[got] <= min(best.values()) + 1e-9, token
    # letters apart: a word may end between any two of them
    for token in ("idiothe", "youare", "stu"):
        best = {}
        for ends in itertools.product((False, True), repeat=len(token) - 1):
            t, a, b, text = 0.0, 0, 0, ""
            for i, c in enumerate(token):
                if i and ends[i - 1]:
                    t, a, b, text = t + COST_SPACE + restorer.cost[a][b][0], b, 0, text + " "
                k = _class(c)
                t, a, b, text = t + restorer.cost[a][b][k], b, k, text + c
            best[text] = t + restorer.cost[a][b][0]
        assert best[" ".join(restorer.decode(lattice(token), spaced=True))] <= min(best.values()) + 1e-9


def test_disguises_of_any_length_and_without_letters(restorer):
    assert [restorer.word(t) for t in ("5#!7", "!d!ot", "455", "@$$", "1d10t!", "(stupid)", "stuupid", "tr4$h.", "...", "--")][0] == ("shit",)
    assert restorer.word("!d!ot") == ("idiot",) and restorer.word("(stupid)") == ("stupid",) and restorer.word("stuupid") == ("stupid",)
    assert all(restorer.word(t) for t in ("455", "@$$")) and not restorer.word("...") and restorer.word("tr4$h.") == ("trash",)
    assert restorer.word("1d10t" * 100) == ("idiot" * 100,)
    assert restorer.word("i-d-i-o-t-" * 50) == ("idiot" * 50,)
    apart = set(restorer.words(" ".join("youareanidiot" * 40)))
    assert any("idiot" in w for w in apart)
    # what the beam hands on early is what it would have kept: a long lattice is its own pieces
    from treelake.llm.toxicity import lattice

    once = " ".join(restorer.decode(lattice("tr4sh.")))
    assert "".join(restorer.decode(lattice("tr4sh." * 400))) == once * 400


def test_weights_reach_the_optimum():
    import numpy as np

    from treelake.llm.toxicity import fit_weights

    rng = np.random.default_rng(1)
    truth = np.array([2.0, 1.0, 0.0, 3.0, 0.5, 0.0])
    data = []
    for _ in range(600):
        x = [int(i) for i in np.nonzero(rng.random(6) < 0.3)[0]]
        data.append((x, int(rng.random() < 1 / (1 + math.exp(2.0 - truth[x].sum())))))
    w, b = fit_weights(data, 6, 0.5, epochs=3000)
    m = np.zeros((len(data), 6))
    for r, (x, _) in enumerate(data):
        m[r, x] = 1
    y = np.array([t for _, t in data])

    def loss(w, b):
        z = m @ w + b
        return float((np.logaddexp(0, z) - y * z).mean() + 5e-4 * (w @ w) / len(y))

    v, c = np.zeros(6), 0.0  # plain projected gradient descent
    for _ in range(20_000):
        g = (1 / (1 + np.exp(-(m @ v + c))) - y) / len(y)
        v, c = np.maximum(v - 0.5 * (m.T @ g + 1e-3 * v / len(y)), 0), c - 0.5 * g.sum()
    assert loss(w, b) < loss(v, c) + 1e-4 and np.all(w >= 0)


def best_cost(name, counts, total):
    """The least cost of any split, by trying all last words."""
    unknown, best = math.log(total + 1) + 2.0, [0.0]
    for end in range(1, len(name) + 1):
        best.append(min(best[i] + (-math.log(counts[name[i:end]] / (total + 1)) if name[i:end] in counts else unknown * (0.6 + 0.4 * (end - i))) for i in range(end)))
    return best[-1]


def test_segmenter_finds_the_best_split():
    from treelake.llm.urlfilter import Segmenter

    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))): rng.randint(1, 50) for _ in range(60)}
    words |= {"abcabc" * 7: 9, "abcabc" * 6 + "b": 3, "c" * 30: 1}
    total = sum(words.values())
    cut = Segmenter(words.items(), total)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(200)] + ["a" + "abcabc" * 7 + "c" * 31, "d" * 200, ""]
    for name in names:
        got = cut.split(name)
        assert "".join(got) == name
        cost = sum(-math.log(words[w] / (total + 1)) if w in words else cut.unknown * (0.6 + 0.4 * len(w)) for w in got)
        assert cost <= best_cost(name, words, total) + 1e-6
    assert Segmenter({"casino": 9, "win": 5, "cas": 1}.items(), 15).split("casinowin") == ("casino", "win")


def test_url_verdicts_match_brute_force(spark):
    from treelake.llm.urlfilter import Segmenter, judge_urls

    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    rows += [(900, "http://pillscasino.example.org/en/x", "<b>Pills</b> casino"), (900, "http://pillscasino.example.org/en/x", "<b>Pills</b> casino"), (901, "x://cheapbets.org/" + "bets" * 500, None), (902, None, None), (None, "http://a.example.net/de/7", "")]
    pages = spark.createDataFrame([(*r, "h", 3) for r in rows], "page_id long, url string, html string, rule string, row int")
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark, pages).collect())
    assert got == Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark, pages.repartition(5), block=7).collect())
    words = Counter(w for _, u, h in rows for w in re.split(r"[\W\d_]+", ((u or "") + " " + re.sub(r"<[^>]*>", " ", h or "")).lower()) if w)
    cut = Segmenter(words.items(), sum(words.values()))

    def tokens(host, path):
        return [t for k, part in (("h:", host), ("p:", path)) for run in re.findall(r"[^\W\d_]+|\d+", part.lower()) for t in (["#" + k] if run[0].isdigit() else [k + w for w in cut.split(run)])]

    judged = [(p, h, s, r, v) for (p, h, s, r, v), n in got.items() for _ in range(n)]
    seen = {"allow": Counter(), "block": Counter()}
    for _, h, s, r, v in judged:
        if r is not None:
            seen[v].update(tokens(h, s))
    size = len(set(seen["allow"]) | set(seen["block"])) + 1
    log = lambda v, t: math.log((seen[v][t] + 1) / (sum(seen[v].values()) + size))
    n = Counter(v for *_, r, v in judged if r is not None)
    for _, h, s, r, v in judged:
        if r is None:
            z = math.log((n["block"] + 1) / (n["allow"] + 1)) + sum(log("block", t) - log("allow", t) for t in tokens(h, s))
            assert abs(z) < 1e-6 or v == ("block" if z > 0 else "allow"), (h, s, z)
    assert {v for *_, r, v in judged if r is None} and len(judged) == len(rows)
