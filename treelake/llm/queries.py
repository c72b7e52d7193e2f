"""The queries op1 to op13 and the pipeline, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_documents
from .decontam import find_leaks
from .langid import predict_language
from .lines import drop_common_lines
from .lloyd import lloyd_clusters, on_grid
from .mixing import mixed_words
from .simhash import simhash_components
from .substring import remove_repeats
from .tokens import token_counts
from .topk import exact_top_k, quantize
from .toxicity import score_toxicity
from .urlfilter import judge_urls
from .warc import archive_round_trip


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark, _read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantize(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return exact_top_k(spark, vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark, _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_language(spark, _read(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(spark, _read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark, _read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "benchmark", "item_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, _read(spark, sf_dir, "documents", "doc_id", "text")).drop("kept_text")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, _read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark, _read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark, _read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = lloyd_clusters(spark, on_grid(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), dim=64), k=40, rounds=5, seed="2")
    return clusters.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_common_lines(spark, _read(spark, sf_dir, "documents", "doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align_documents(spark, _read(spark, sf_dir, "documents", "doc_id", "text"))
    return aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_top_k, op3_toxicity, op4_language_id, op5_mixing, op6_decontamination, op7_substring_dedup, op8_token_counts, op9_url_filters, op10_warc, op11_centroids, op12_line_dedup, op13_token_alignment, pipeline)
}



def _lloyd_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds, a pair of steps for each; doubles hold whole numbers below 2^53 exactly."""
    d = "CAST(list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS BIGINT)"
    near = lambda i: f"a{i} AS MATERIALIZED (SELECT * FROM (SELECT r, vec_id, v, cluster, {d} AS distance FROM v, c{i}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, cluster) = 1)"
    mean = lambda i: (
        f"m{i} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY p) AS c FROM (SELECT cluster, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(64)) AS p FROM a{i}) GROUP BY cluster, p) GROUP BY cluster), "
        f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))"
    )
    steps = ", ".join(f"{near(i)}, {mean(i)}" for i in range(rounds))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS cluster, v AS c FROM (SELECT sha256('2:' || vec_id) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT {k})),
{steps}, {near(rounds)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE: dict[str, str] = {
    "op11_centroids": _lloyd_sql(),
    "op12_line_dedup": """
WITH b AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blank),
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS p FROM documents),
k AS (SELECT doc_id, line, p, translate(trim(line, blank), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l, b),
common AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (common.key IS NULL), '')) AS kept_sha256
 FROM k LEFT JOIN common USING (key) GROUP BY doc_id""",
    "op2_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5""",
    "op7_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (k) WHERE m < doc_id),
each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.p) AS kept, count(*) AS n FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', substr(sha1(html), i, 1))]), '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, 5 * j + 1, 5) AS INTEGER), 1)), '') AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM d""",
}
