"""What a task of the pipeline holds, and what decontamination shuffles."""

import sys

import pyarrow as pa
import pytest

import corpus_pipeline
from treelake.llm import decontam
from treelake.llm.scratch import as_batch, first_by_hash, slices


def test_equal_words_of_a_batch_are_held_once():
    rows = as_batch("doc_id long, t1 long, text string", [1, 2, None], [None, None, 7], ["Some words and some words", "words AND more", None])
    (held,) = decontam._by_bytes([rows], 1 << 20)
    assert [r[2] for r in held] == [["some", "words", "and", "some", "words"], ["words", "and", "more"], []]
    words = [w for r in held for w in r[2]]
    assert len({id(w) for w in words}) == len(set(words)) == 4


def test_texts_of_many_different_words_are_taken_in_parts():
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(10)]
    rows = as_batch("doc_id long, t1 long, text string", list(range(10)), [None] * 10, texts)
    parts = list(decontam._by_bytes([rows], 1 << 20, 250))
    assert [len(p) for p in parts] == [3, 3, 3, 1]
    assert [r[2] for p in parts for r in p] == [t.split() for t in texts]


def test_few_leaks_meet_the_documents_without_a_shuffle_of_texts(spark):
    item = "What colour has the sea at night in winter? It has the colour of very old iron."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {item} yes"), (1, "other text"), (2, "nothing here"), (None, f"and {item}"), (None, "free"), (3, None)], "doc_id long, text string")
    out = decontam.drop_leaks(spark, docs, bench)
    assert sorted(map(str, out.collect())) == sorted(map(str, docs.where("coalesce(doc_id, 0) > 1 or text = 'free'").collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_stages_hand_few_texts_at_a_time_to_python(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    docs = spark.createDataFrame([(1, "a few words", "en", "x", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "an item of some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    try:
        for given, most in (("10000", 1024), ("100", 100)):
            spark.conf.set(key, given)
            assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 1
            got = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()
            assert max(r.n for r in got) == most and sum(r.n for r in got) == 5000
    finally:
        spark.conf.set(key, was)


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_task_gives_back_what_it_and_the_one_before_freed():
    def held():  # MB
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    def filled():
        blocks = [bytearray(b"x" * 50_000) for _ in range(3000)]
        return blocks.pop()  # the last one keeps the heap from shrinking

    rows = as_batch("doc_id long", [1, 2])
    pins, was = [filled()], held()
    todo = slices([rows])
    assert next(todo).num_rows == 2
    assert was - held() > 100  # of 150 MB
    pins.append(filled())
    was = held()
    assert next(todo, None) is None
    assert was - held() > 100 and len(pins) == 2


def test_counts_of_labels_take_no_python_workers(spark):
    ids = spark.range(50).selectExpr("id AS doc_id", "if(id % 2 = 0, 'a', 'b') AS lang")
    out = first_by_hash(ids, "lang", 5)
    assert sorted(r.lang for r in out.collect()) == ["a"] * 5 + ["b"] * 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ExistingRDD" not in plan
