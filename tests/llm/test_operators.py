"""Every operator against a brute-force version, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EMPTY = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema=EMPTY):
    return spark.createDataFrame(rows, schema)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = WORD.findall(lower(text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, budget=3):
    """rows: (doc_id, fp) -> smallest doc_id reachable, by union-find over all pairs."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= budget:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, format(f, "016x"), least.get(find(f))) for d, f in rows]


def test_simhash_matches_all_pairs(spark):
    from treelake.llm.simhash import simhash_components

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1003, "one"), (None, "one Two"), (1004, "x" * 50_000 + " y z w"), (1005, "ÀB c\x0bd\x0ce\xa0f")]
    got = simhash_components(spark, frame(spark, [(d, t, "l", "s", 1, 2) for d, t in docs], EMPTY + ", fp int, component int"))
    want = brute_components([(d, brute_fingerprint(t)) for d, t in docs])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == Counter(want)
    assert simhash_components(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("bucket", [4096, 3])
def test_hamming_links_lose_none(spark, bucket):
    from treelake.llm.scratch import Scratch
    from treelake.llm.simhash import hamming_links

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << i for i in rng.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 3, 4, 5) for _ in range(6)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    got = hamming_links(spark, spark.createDataFrame([(f,) for f in signed], "fp long"), Scratch(spark, "test"), bucket=bucket)
    mask = (1 << 64) - 1
    want = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & mask).count("1") <= 3}
    assert {(r.a, r.b) for r in got.collect()} == want and want


def test_components_of_a_chain_and_a_star(spark):
    from treelake.llm.components import connected_components
    from treelake.llm.scratch import Scratch

    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}}


def test_top_k_matches_brute_force(spark):
    from treelake.llm.topk import exact_top_k, quantize

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(160).collect()]
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, rows[0][1]), (903, None), (904, [float("nan")] * 64), (905, [None] + [0.1] * 63), (None, rows[1][1]), (906, [0.5]), (907, [-1e-20] * 64), (950, [-1e-20, 1e-20] * 32)]
    vectors = quantize(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, tile int"))
    got = exact_top_k(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5, tile=16, query_tile=3, shard_bytes=16_000, fan_in=2).collect()
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sound:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert quantize(spark.createDataFrame([(1, [-1e-20, 0.0, 1e300, -1e300])], "vec_id long, embedding array<double>")).first().v == [-1.0, 0.0, 256e300, -256e300]
    empty = vectors.limit(0)
    assert exact_top_k(spark, empty, empty).count() == 0


def brute_repeats(rows, window=50):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(math.inf if d is None else d, first.get(key, math.inf))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (math.inf if d is None else d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substring_dedup_matches_brute_force(spark):
    from treelake.llm.substring import cut_repeats, remove_repeats

    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "cc", "d\xa0d", "É", "f."])
    passages = [[word() for _ in range(n)] for n in (50, 51, 49, 80, 120)]
    rows = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 90))]
        for p in rng.sample(passages, 2):
            at = rng.randint(0, len(w))
            w[at:at] = p
        rows.append((d, rng.choice([" ", "\n", "\t "]).join(w)))
    rows += [(100, rows[7][1]), (101, rows[7][1]), (101, rows[9][1]), (102, None), (103, ""), (104, "z " * 400), (105, "z " * 300), (106, "z " * 49), (107, "solo " * 60), (107, "other " * 70), ((1 << 63) - 1, rows[5][1] + " end")]
    got = remove_repeats(spark, frame(spark, [(d, t, "l", "s", 1, "x") for d, t in rows], EMPTY + ", doc int, shared string")).collect()
    want = brute_repeats(rows)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(want)
    assert remove_repeats(spark, frame(spark, [])).count() == 0
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = remove_repeats(spark, frame(spark, [(d, t, "", "") for d, t in real])).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(brute_repeats(real))
    # rows without an id come last, and many of them are no one row
    lost = [(None, f"{rows[4][1]} tail {i % 50} " + "pad " * (i % 9)) for i in range(2000)] + [(None, "only nulls have this " * 20)] * 30
    got = remove_repeats(spark, frame(spark, [(d, t, "l", "s") for d, t in rows + lost])).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == Counter(brute_repeats(rows + lost))
    cut = {r.doc_id: r.text for r in cut_repeats(spark, frame(spark, [(d, t, "l", "s") for d, t in rows if d < 101])).collect()}
    gone = {d for d, n, k, _ in want if n == k and n and d < 101}
    assert gone and not gone & set(cut) and all(d in cut for d, _, k, _ in want if d < 101 and not k)


def test_token_counts_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from treelake.llm.tokens import token_counts

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += [None, "", " ", "\n\n  x", "a<|endoftext|>b", "don't we'll I'M", "x\x1c\x1dy\u3000z", "日本語 emoji 😀😀", "tab\t\t end  ", "१२३ ½ ²", "w" * 5000, "é\u0301 n\u0303", "ab " * 400_000]
    got = token_counts(spark, frame(spark, [(i, x, "", "") for i, x in enumerate(texts)])).collect()
    for r in got:
        x = texts[r.doc_id] or ""
        n = len(t.encode(x, add_special_tokens=False))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(x.encode()), n, n > 1024), r.doc_id
    assert len(got) == len(texts) and token_counts(spark, frame(spark, [])).count() == 0


def fill_targets(sizes, weights, total, most=2.0):
    """Share by weight; what exceeds is shared anew among the rest, until none exceeds."""
    target, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in over or open_:
            target[i] = most * sizes[i] if over else unit * weights[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in over] if over else []
    return target


def brute_mix(spark, rows, targets, block=512, seed=5):
    """taken of each row: its source's stream of at most two passes, cut at the target."""
    from treelake.llm.mixing import RANGE

    ids = sorted({d for d, *_ in rows}, key=lambda d: (d is not None, d))
    mixed = {r.d: r.m for r in spark.createDataFrame([(d,) for d in ids], "d long").select("d", F.xxhash64(F.coalesce("d", F.lit((1 << 63) - 1)), F.lit(seed)).alias("m")).collect()}
    ranges, out = -(-len(rows) // RANGE), []
    for source in {s for *_, s in rows}:
        stream = sorted((((mixed[d] >> 40) % ranges, mixed[d], (d is not None, d or 0), len(WORD.findall(t or ""))), d) for d, t, _, s in rows if s == source)
        size, at = sum(k[3] for k, _ in stream), 0
        for key, d in stream:
            taken = sum(max(0, min(at + again * size + key[3], int(targets[source])) - at - again * size) for again in (0, 1))
            out.append((d, key[3], taken))
            at += key[3]
    return out


def test_mixing_meets_targets(spark):
    from treelake.llm.mixing import mix, mixed_words

    assert fill_targets([100, 100, 100], [5, 2, 1], 450) == pytest.approx([200, 500 / 3, 250 / 3])
    assert fill_targets([0, 10], [5, 2], 15) == [0, 15]
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice([0, 1, 5, 60, 3000]), "", rng.choice(["b", "a", "c", None])) for i in range(200)] + [(3, "x y", "", "a"), (3, "x y", "", "a"), (None, "q", "", "z"), (7, None, "", "empty")] + [(None, "w " * (i % 4), "", "a") for i in range(300)] + [(8, "y z", "", f"s{i}") for i in range(50)]
    docs = frame(spark, [(*r, 1, 2) for r in rows], EMPTY + ", s int, rank int")
    got = mixed_words(spark, docs).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, fill_targets([sizes[s] for s in names], [(5.0, 2.0, 1.0)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()))))
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in got) == Counter((d, len(WORD.findall(t or "")), sizes[s], round(target[s], 6)) for d, t, _, s in rows)
    taken = Counter()
    for r in got:
        taken[round(r.target, 6)] += r.taken
    assert all(abs(n - t * sum(round(x, 6) == t for x in target.values())) <= 4 for t, n in taken.items())
    assert Counter((r.doc_id, r.size, r.taken) for r in got) == Counter(brute_mix(spark, rows, target))
    assert Counter(mixed_words(spark, docs.repartition(7)).collect()) == Counter(got)
    pieces, _ = mix(spark, docs)
    slots = pieces.select("slot", "s").distinct().orderBy("slot").collect()
    assert len({r.slot for r in slots}) == len(slots)  # no slot goes to two sources
    half = Counter(r.s for r in slots[: len(slots) // 2])
    whole = Counter(r.s for r in slots)
    assert all(abs(half[s] - whole[s] / 2) <= 6 for s in whole)  # even along the mix
    assert mixed_words(spark, frame(spark, [])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    import io

    from treelake.llm.warc import archive_round_trip, payload_digest, read_archive, write_archives
    from treelake.llm.scratch import Scratch

    rows = [(5, "http://a/", "same"), (2, "http://b/", "same"), (9, None, "same"), (1, "http://c/\r\nX", None), (3, "http://d/", ""), (4, "u", "é" * 9000), (None, "n", "same"), (None, "n", "alone"), (6, "r", "twice"), (6, "r", "twice")]
    rows += [(100 + i, f"http://x/{i}", f"<p>page {i} {'text ' * 50}</p>") for i in range(700)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string")
    got = archive_round_trip(spark, pages).collect()
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        ids = [q for q, _, g in rows if (g or "") == (h or "") and q is not None]
        least = min(ids, default=None)
        again = least is not None and (p is None or p > least)
        want.append((p, len(b), payload_digest(b), "revisit" if again else "response", least if again else None))
    assert Counter(tuple(r) for r in got) == Counter(want)
    assert archive_round_trip(spark, pages.limit(0)).count() == 0
    files = write_archives(spark, pages, f"file://{tmp_path}/w", Scratch(spark, "test"), samples=20, roll=20_000).collect()
    payloads = Counter()
    for f in files:
        with open(f.path, "rb") as s:
            data = s.read()
        assert data[:4] == bytes.fromhex("5d2a4d18")
        records = list(read_archive(io.BytesIO(data)))
        assert len(records) == f.records
        payloads.update(b for h, b in records if h["WARC-Type"] == "response")
    assert len(files) > 3 and payloads["same".encode()] == 1 and payloads["twice".encode()] == 2 and not list(tmp_path.glob("w/.part*"))


def test_url_parts_rules_and_words(spark):
    from treelake.llm.urlfilter import judge_urls

    urls = ["http://WWW.Example.com/en/x", "https://a.example.com/en/1", "http://example.com/de/", "http://net/es/", "http://x.net/FR/", "http://x.net/fr/a?q", "http://com", "http://com/", "http://xcom/", None, "no scheme", "", "a://b://c/d", "http://h?x://y", "http://ÀÉ.NET/es/#f"] + [f"http://casinowin{i}.example.org/en/{i}" for i in range(5)]
    pages = spark.createDataFrame([(i, u, "casino win" * 3, 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in judge_urls(spark, pages).collect()}
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
        host, path = lower(host), re.match(r"[^?#]*", tail)[0]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[1] if fits else None)
        assert got[i].verdict == max(fits)[2] if fits else got[i].verdict in ("allow", "block")
    assert judge_urls(spark, pages.limit(0)).count() == 0


def test_language_accuracy_held_out(spark):
    from treelake.llm.langid import predict_language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = frame(spark, [(None, "the", None, ""), (70_001, None, "en", ""), (70_002, "123 %%%", "en", ""), (70_003, "", None, ""), (70_003, "", None, "")])
    both = docs.select("doc_id", "text", "lang", "source").unionByName(extra)
    got = predict_language(spark, both).collect()
    assert len(got) == docs.count() + 5
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if (r.doc_id or 0) > 70_000)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.lang_pred == truth[r.doc_id] for r in tested) > 0.97 * len(tested)
    assert sum(r.rejected for r in tested) < 0.02 * len(tested) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in predict_language(spark, extra.where("lang is null")).collect()} == {"und"}


def test_restoring_disguised_words(spark):
    from treelake.llm.toxicity import CharModel, Restorer, char_counts

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = frame(spark, [(i, "you are an idiot and a stupid loser, pathetic trash " * 20, "", "") for i in range(40)])
    model = Restorer(CharModel(char_counts(spark, docs.select("text").unionByName(text.select("text")))))
    assert {"idiot", "stupid", "loser", "trash"} <= model.words("1d10t stuuuupid l0ser tr4sh")
    assert "idiot" in model.words("what an i d i o t he") and "idiot" in model.words("i-d-i-o-t")
    assert model.words("plain words, here.") == {"plain", "words", "here"} and model.words(None) == set()


def test_toxicity_held_out(spark):
    from treelake.llm.toxicity import score_toxicity

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "lang", "source")
    extra = frame(spark, [(None, "idiot", "", ""), (90_001, None, "", ""), (90_002, "", "", ""), (90_002, "", "", "")])
    got = score_toxicity(spark, docs.unionByName(extra), labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == docs.count() + 4 and len(tested) > 500
    assert sum(r.predicted == truth[r.doc_id] for r in tested) > 0.97 * len(tested)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    none = score_toxicity(spark, extra, labels.limit(0))
    assert {r.predicted for r in none.collect()} == {0}


def test_leaks_match_brute_force(spark):
    from treelake.llm.decontam import Index, find_leaks, question_and_answer, shingles, words_of

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    edited = items[3][1].split()
    edited[10] = "changed"
    docs += [(1000, "pre " * 37 + items[0][1].upper() + " post" * 91), (1001, items[1][1] + " " + items[2][1]), (1002, " ".join(items[3][1].split()[:12])), (1003, None), (1004, ""), (None, items[5][1])]
    items += [(None, "x y z"), (900, None), (901, ""), (902, items[0][1]), (903, "tiny")]
    got = find_leaks(spark, frame(spark, [(d, t, "", "") for d, t in docs]), spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, score double"), shard_bytes=2000).collect()
    want = set()
    for d, t in docs:
        have = shingles(words_of(t))
        for i, x in items:
            if i is None or not x or len(words_of(x)) < 5:
                continue
            q, a = question_and_answer(x)
            share = lambda p: len(shingles(p) & have) / len(shingles(p)) if len(p) >= 5 else float(f" {' '.join(p)} " in f" {' '.join(words_of(t))} ")
            if share(q) >= 0.8 and share(a) >= 0.8:
                want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in got} == want and {(1000, 0), (1000, 902), (1001, 1), (1001, 2), (None, 5)} <= want
    assert find_leaks(spark, frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0
    small, large = ({tuple(r) for r in find_leaks(spark, frame(spark, [(d, t, "", "") for d, t in docs]), spark.createDataFrame([(*i, 0.5) for i in items], "item_id long, text string, score double"), shard_bytes=n).collect()} for n in (200, 8 << 20))
    assert small == large == {tuple(r) for r in got}  # shards decide no column
    # block-max skipping gives what scoring every item gives
    kept = [(i, x) for i, x in items if i is not None and x and words_of(x)]
    lengths = [len(words_of(x)) for _, x in kept]
    df = Counter(t for _, x in kept for t in set(words_of(x)))
    index, rng = Index(kept, df, len(kept), sum(lengths) / len(kept), max(lengths)), random.Random(6)
    import numpy as np

    for _ in range(200):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), rng.randint(1, 200))))
        full = np.zeros(len(index.items))
        for t in terms:
            for p in range(index.post_at[t], index.post_at[t + 1]):
                full[index.post_item[p]] += index.post_impact[p]
        found = index.search(np.zeros(len(terms), int), terms, 1, 0.2)
        assert [i for _, i, _ in found] == [i for i in range(len(full)) if full[i] >= 0.2 - 1e-12] or np.isclose(full, 0.2).any()


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline
    from treelake.llm.simhash import simhash_components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, names = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.schema.names == docs.schema.names
        assert after.join(now, "doc_id", "left_anti").count() == 0
        now = after.cache()
        names.append(now.count())
    groups = simhash_components(spark, docs).select("component_id").distinct().count()
    assert names[1] >= groups - 3 and names[-1] > 0.6 * docs.count()
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == names[-1] and set(out.columns) >= {"doc_id", "size", "source_size", "target", "taken"}


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, s string, word array<string>, _gone long, _doc string, _whole boolean"
    base = [(i, t, "en", "a", len(t), 1, "x", ["y"], i, "d", True) for i, t in enumerate(["the cat sat on the mat " * 3, "of all the things in the world", "and then there was light"])]
    odd = [(10, None, None, None, None, None, None, None), (11, "", "en", "a", 0, 1, "", []), (None, "the cat and the hat", "en", None, 1, 1, "", []), (12, "of the", "en", "b", 6, 1, "", []), (12, "of the", "en", "b", 6, 1, "", [])]
    odd = [(*x, 12, None, False) for x in odd]
    for rows in ([], base + odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.schema.names == [x.split()[0] for x in schema.split(", ")], name
        kept = docs.collect()
        assert {r.doc_id for r in kept} == ({0, 1, 2, None, 12} if rows else set())
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
        assert len(last) == len(kept) and all(0 <= r.taken <= 2 * r.size for r in last)


def test_bounded_helpers(spark):
    from treelake.llm.scratch import first_by_hash

    ids = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 7 == 0).alias("k"))
    got = first_by_hash(ids.unionByName(ids), "k", 100).collect()
    by = {}
    for r in ids.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))).collect():
        by.setdefault(r.k, []).append((r.h, r.doc_id))
    assert sorted((r.k, r.doc_id) for r in got) == sorted((k, d) for k, v in by.items() for _, d in sorted(v)[:100])
