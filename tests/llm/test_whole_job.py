"""Operators on inputs where doing less than the whole job shows."""

import random


def brute_groups(rows):
    """The smallest doc_id that links of Jaccard similarity >= 0.8 of five-word shingles reach, by union-find over all pairs."""
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {find(d) for d in ids}


def test_near_dedup_finds_all_similar_pairs(spark):
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for _ in range(12):
        w = [word() for _ in range(rng.randint(30, 250))]
        rows.append(list(w))
        for _ in range(6):  # chains and stars of copies around the threshold
            v = list(w)
            for at in rng.sample(range(len(v)), max(1, len(v) // rng.choice([40, 55, 60, 90]))):
                v[at] = word()
            rows.append(v)
            if rng.random() < 0.5:
                w = v
    base = [f"a{i}" for i in range(40)]
    rows += [base, base[:33]]  # 29 of 36 shingles: above 0.8
    rows += [[f"b{i}" for i in range(29)], [f"b{i}" for i in range(24)], [f"c{i}" for i in range(29)], [f"c{i}" for i in range(23)]]  # exactly 20/25, and 19/25
    rows += [["one"], ["one"], ["one", "two"], []]
    docs = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(docs)
    frame = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").select("doc_id").collect()}
    assert got == brute_groups(docs)
