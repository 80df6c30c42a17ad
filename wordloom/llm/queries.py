"""Queries of this subpackage, one for each numbered operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import licenses, privacy, quality, toxicity
from wordloom.llm.ann import nearest
from wordloom.llm.bpe import encode_documents, load_ranks
from wordloom.llm.line_dedup import dedup_lines
from wordloom.llm.packing import pack_documents
from wordloom.llm.shared import SMALL_BATCHES, held_out, shared_dir, written
from wordloom.llm.simhash import near_duplicates
from wordloom.llm.spelling import spelling_variants
from wordloom.llm.token_files import read_token_files, write_token_files
from wordloom.llm.topk import exact_top_k, usable
from wordloom.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(_table(spark, sf_dir, "documents"), load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    digest = F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary")
    digests = coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(digest, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return written(digests, settings=SMALL_BATCHES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "removed_chunks", "removed_chars")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return nearest(rows.filter("vec_id % 50 = 0"), rows, k=5)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = toxicity.score_toxicity(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scores = quality.score_quality(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    doubles = F.col("embedding").cast("array<double>")
    whole = _table(spark, sf_dir, "embeddings").filter(usable(doubles)).select("vec_id", F.transform(doubles, lambda x: F.floor(x * 256)).alias("vector"))
    return exact_top_k(whole.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), whole, k=5)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.sanitise(_table(spark, sf_dir, "documents"))
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(privacy.PATTERNS)]
    return found.select("doc_id", *counts, F.sha2(privacy.listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), privacy.listed(F.col("spans")).alias("spans"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_line_dedup": op2_line_dedup,
    "op3_token_files": op3_token_files,
    "op4_licenses": op4_licenses,
    "op5_multiprobe": op5_multiprobe,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_disclosure": op12_disclosure,
    "op13_whitening": op13_whitening,
}

_OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5"""

_OP11 = """
WITH RECURSIVE t AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS p, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT p, w, count(*) AS n FROM t WHERE length(w) >= 7 GROUP BY p, w),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS r),
h AS (SELECT w, n, xor(list_reduce(list_transform(range(octet_length(encode(p || w))), lambda i: CAST('0x' || substr(hex(encode(p || w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
        lambda c, b: xor(c // 256, r[CAST(xor(c % 256, b) + 1 AS BIGINT)]), 4294967295), 4294967295) AS h FROM d, crc),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) + 2 AS BIGINT)) ELSE w END AS word, n FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word FROM cut c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word FROM cut c JOIN v ON c.rest = v.word),
best AS (SELECT p.word, count(*) AS n_near, arg_max(v.word, (v.n, -rank)) AS form, max(v.n) AS form_n FROM pairs p JOIN (SELECT word, n, row_number() OVER (ORDER BY word) AS rank FROM v) v ON v.word = p.near GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form, CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM v LEFT JOIN best USING (word)),
up(word, root, k) AS (SELECT word, form, 1 FROM f WHERE form IS NOT NULL UNION ALL SELECT up.word, f.form, k + 1 FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(r.root, f.word) AS root FROM f LEFT JOIN (SELECT word, arg_max(root, k) AS root FROM up GROUP BY word) r USING (word)"""

ORACLE_SQL: dict[str, str] = {"op4_licenses": licenses.oracle_sql(), "op10_exact_top_k": _OP10, "op11_spelling_variants": _OP11, "op12_disclosure": privacy.oracle_sql()}
