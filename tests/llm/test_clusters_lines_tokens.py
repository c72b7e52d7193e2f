"""op11 to op13 against brute force, with nulls, ties, repeats, empty tables, very long texts and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
BLANK = "".join(map(chr, [32, *range(9, 14)]))


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_centroids", "op12_line_dedup"])
def test_query_matches_sql(spark, name):
    from treelake.llm.queries import ORACLE, QUERIES

    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = want.fetchall()
    assert len(rows) > 100
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(rows)


# --- op11


def brute_lloyd(rows, k, rounds, seed):
    c = [v for _, v in sorted(rows, key=lambda r: (r[0] is None, sha(f"{seed}:{r[0]}"), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        got = defaultdict(list)
        for _, v in rows:
            got[near(v)[1]].append(v)
        for j, vs in got.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    at = [(i, *near(v)) for i, v in rows]
    own = Counter()
    for _, d, j in at:
        own[j] += d
    cap = lambda x: min(x, 2**63 - 1)
    return [(i, j, cap(d), cap(own[j]), cap(sum(own.values())), c[j]) for i, d, j in at]


@pytest.mark.parametrize("dim, wide, k", [(2, 5, 4), (3, 1000, 7), (2, 2**40, 3), (4, 2**62, 3), (2, 3, 100)])
def test_clusters_match_brute_force(spark, dim, wide, k):
    from treelake.llm.lloyd import lloyd_clusters

    rng = random.Random(dim * 31 + k)
    rows = [(i if i % 13 else None, [rng.randint(-wide, wide) for _ in range(dim)]) for i in range(60)]
    rows += rows[5:9] + [(200 + i, rows[3][1]) for i in range(30)]  # repeated rows, and a third with one vector
    got = lloyd_clusters(spark, spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(5), k, 3, "2").collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got), key=key) == sorted(brute_lloyd(rows, k, 3, "2"), key=key)


def test_grid_keeps_sound_vectors_only(spark):
    from treelake.llm.lloyd import lloyd_clusters, on_grid

    nan, inf = math.nan, math.inf
    rows = [(1, [0.5, -0.001], "x"), (2, [nan, 0.0], "x"), (3, None, "x"), (4, [1.0], "x"), (5, [inf, 0.0], "x"), (6, [None, 1.0], "x"), (None, [1e300, 0.0], None), (7, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    grid = on_grid(df, 2)
    assert sorted(map(tuple, grid.collect()), key=str) == sorted([(1, [128, -1]), (None, [2**63 - 1, 0])], key=str)
    assert lloyd_clusters(spark, grid.where("vec_id = 99")).count() == 0
    assert lloyd_clusters(spark, grid, 3, 2).count() == 2


# --- op12


def brute_lines(rows, min_docs, min_chars=1):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(BLANK))
    has = Counter(k for _, t in set((d, t or "") for d, t in rows) for k in {key(x) for x in t.split("\n")} if len(k) >= min_chars)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if has[key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str)


def test_lines_match_brute_force(spark):
    from treelake.llm.lines import drop_common_lines

    rng = random.Random(3)
    pool = ["Menu", " menu\t", "MENU", "", "  ", "Ärger", "ärger", "\x0bHome\r", "home", "ÄRGER", "\xa0home", "🙂", "a" * 5000, *[f"line {i}" for i in range(40)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n"), (503, "menu\n" * 3), (None, "menu\nonly here"), (None, "menu\nthere"), (1, "another text of one\nmenu"), rows[7], rows[7]]
    rows += [(600, "\n".join(["menu", *[f"own {i}" for i in range(300)], "home", "x"] * 5))]  # several words of a bitmap, gaps in between
    for min_docs, min_chars in ((10, 1), (3, 1), (2, 5), (1, 1)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        assert as_rows(drop_common_lines(spark, docs, min_docs, min_chars)) == sorted(brute_lines(rows, min_docs, min_chars), key=str)


def test_hot_line_and_long_document(spark):
    from treelake.llm.lines import drop_common_lines

    rows = [(i, f"cookie notice\nown {i}") for i in range(5000)] + [(9000, "\n".join(f"row {i}\ncookie notice" for i in range(100_000)))]
    got = {r.doc_id: r for r in drop_common_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 5001 and all(got[i].kept_text == f"own {i}" for i in range(5000))
    assert got[9000].n_dropped == 100_000 and got[9000].kept_text == "\n".join(f"row {i}" for i in range(100_000))


def test_bitmaps_are_of_losing_documents(spark):
    from treelake.llm.lines import line_bitmaps

    rows = [(1, "x\n" + "y\n" * 70 + "x"), (2, "x"), (3, "z")]
    got = {r.doc_id: r.keep for r in line_bitmaps(spark, spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {1: [~1, ~(1 << 7)], 2: [~1]}


def test_lines_keep_clashing_columns_and_empty_tables(spark):
    from treelake.llm.lines import drop_common_lines

    rows = [(1, "x", "a", "b", 5, "k"), (2, "x", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string, copy string, n_lines int, _copy string")
    got = drop_common_lines(spark, docs, 2)
    assert got.columns == ["doc_id", "text", "keep", "copy", "_copy", "n_lines", "n_dropped", "kept_text"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", "a", "b", "k", 1, 1, ""), (2, "x", None, None, None, 1, 1, "")]
    assert drop_common_lines(spark, docs.where("doc_id = 9")).count() == 0


def test_line_dedup_is_native(spark):
    from treelake.llm.queries import op12_line_dedup

    plan = op12_line_dedup(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapPartitions", plan)


# --- op13


@pytest.fixture(scope="module")
def both():
    from treelake.llm.alignment import Aligner, piece_file
    from treelake.llm.tokens import tokenizer_file

    return Aligner(tokenizer_file(), piece_file())


def overlaps(a, b):
    """Pairs of ids whose ranges overlap: all of b that begin before a range's end and end after its start."""
    out, j = [], 0
    for lo, hi, i in a:
        while b[j][1] <= lo:
            j += 1
        k = j
        while k < len(b) and b[k][0] < hi:
            out.append((i, b[k][2]))
            k += 1
    return out


def brute_alignment(both, rows):
    """Whole texts through both libraries, links by comparing all byte ranges, counts over all links."""
    docs = []
    for d, t in rows:
        a = b = []
        if t:
            a, b = both.a.encode(" " + t, add_special_tokens=False).ids, both.b.encode(t)
            joined = [b"".join(table[i] for i in ids) for table, ids in ((both.bytes_a, a), (both.bytes_b, b))]
            if joined != [(" " + t).encode()] * 2:
                a = b = []
        spans = []
        for table, ids in ((both.bytes_a, a), (both.bytes_b, b)):
            ends = [0]
            for i in ids:
                ends.append(ends[-1] + len(table[i]))
            spans.append(list(zip(ends, ends[1:], ids)))
        links = overlaps(*spans)
        cuts = sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]})
        group = lambda s, lo, hi: ",".join(str(i) for x, y, i in s if lo <= x and y <= hi)
        text = ";".join(f"{group(spans[0], lo, hi)}|{group(spans[1], lo, hi)}" for lo, hi in zip([0, *cuts], cuts)) if len(a) < 500 else None
        docs.append((d, len(a), len(b), len(cuts), links, text))
    count = Counter(x for *_, links, _ in docs for x in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(d, na, nb, ng, len(ls), sum(count[x] == best[x[1]] for x in ls), sum(count[x] for x in ls), text) for d, na, nb, ng, ls, text in docs]


TEXTS = [
    None, "", " ", "  ", "\n", "a", "Hello world", "Hello  world \n\n next\tline ", " leading", "trailing ", "don't we'll I'm", "12345 67,8.90", "a▁b c", "▁", "snow▁man snow man",
    "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café — “quotes”", "日本語のテキスト と 漢字", "🙂🙃 emoji 👩‍👩‍👧", "x\r\ny;\r\nz", "a b  c​d", "\x1c\x1d a!\x1c b", "tab\tspace\x0bvt\x0cff",
    "if (x) {\r\n\treturn;\r\n}\r", "word" * 300, "a\x00b", "﻿bom text", "é é", "Привет мир", "नमस्ते दुनिया", "    indented\n        more", "the the the the", "!!! ??? ...", "http://a.b/c?d=e&f",
]


def test_alignment_matches_whole_texts(spark, both):
    from treelake.llm.alignment import align_documents

    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "Hello world"), (3, "the end of the world"), (3, "the end of the world")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, block string").repartition(3)
    want = brute_alignment(both, rows)
    for size in (1, 200, 1 << 20):
        got = align_documents(spark, docs, block_bytes=size)
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_alignment_of_documents(spark, both):
    from treelake.llm.queries import op13_token_alignment

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted(x[:7] for x in brute_alignment(both, rows))
    assert sorted(tuple(r)[:7] for r in op13_token_alignment(spark, SF).collect()) == want


def test_alignment_of_odd_tables(spark):
    from treelake.llm.alignment import align_documents
    from treelake.llm.queries import QUERIES

    docs = spark.createDataFrame([(1, "x " * 200_000 + "y" * 100_000), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in align_documents(spark, docs).collect()}
    assert got[1].n_a > 200_000 and got[1].n_groups == got[1].groups.count(";") + 1 and got[2].groups == ""
    assert align_documents(spark, docs.where("doc_id = 9")).count() == 0
    assert "op13_token_alignment" in QUERIES


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r\x0b\xa0\x1c　​﻿aeT';.,!)}1é中▁")), st.characters(codec="utf-8")), max_size=40))
def test_segments_have_the_tokens_of_the_whole(both, text):
    from treelake.llm.alignment import segments

    s = " " + text
    parts = segments(s)
    assert "".join(parts) == s and all(parts)
    if "▁" in text or not text:
        return
    alone = [both.encode(x) for x in parts]
    assert [i for a, _ in alone for i in a] == both.a.encode(s, add_special_tokens=False).ids
    assert [i for _, b in alone for i in b] == both.b.encode(text)
    random.Random(len(text)).shuffle(parts)  # segments of other texts as neighbours change nothing
    assert [x.groups for x in both.align(parts)] == [y.groups for x in parts for y in both.align([x])]


def test_other_models_are_refused(both):
    from sentencepiece import sentencepiece_model_pb2 as pb

    from treelake.llm.alignment import piece_file, refuse_other_pieces

    spec = pb.ModelProto()
    spec.ParseFromString(piece_file())
    spec.pieces[500].piece = "a▁b"
    with pytest.raises(ValueError, match="reach across"):
        refuse_other_pieces(spec.SerializeToString())
    spec.normalizer_spec.name = "nmt_nfkc"
    with pytest.raises(ValueError, match="may change texts"):
        refuse_other_pieces(spec.SerializeToString())
