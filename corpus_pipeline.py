"""A corpus pipeline: five stages from raw documents to packed training windows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import quality, toxicity
from wordloom.llm.line_dedup import dedup_lines
from wordloom.llm.near_copies import near_copies
from wordloom.llm.packing import pack_documents
from wordloom.llm.shared import shared_dir, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more; null and empty texts are scored as texts of no words."""
    model = quality.train(docs, _labels(spark, sf_dir))
    return _score_first(docs, lambda df: quality.score_quality(df, model), "quality", lambda s: s >= 0.3)


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; null and empty texts are scored as texts of no words."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    return _score_first(docs, lambda df: toxicity.score_toxicity(df, model), "toxicity", lambda s: s < 0.5)


def _plain(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` with names that nothing clashes with, and those of its doc_id and text."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names["doc_id"], names["text"]


def _score_first(docs: DataFrame, score, name: str, keep) -> DataFrame:
    """The rows whose score passes, with the columns of ``docs``, whatever their names."""
    plain, _, text = _plain(docs)
    scores = score(plain.withColumnRenamed(text, "text"))
    return scores.filter(keep(F.col(name))).drop(name).toDF(*docs.columns)


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; n_chars follows the text.

    Null texts stay null; a text of which nothing is left becomes empty.
    """
    plain, doc, text = _plain(docs)
    clean = dedup_lines(plain, doc, text).drop("removed_chunks", "removed_chars").toDF(*docs.columns)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, similarity 0.8 or more), the one of the smallest id.

    Rows without an id come last.  Texts without words, null ones too, are
    copies of each other; different texts of one id all stay.
    """
    plain, doc, text = _plain(docs)
    found = written(near_copies(plain, doc, text), name="near")
    order = F.struct(F.col(doc).isNull(), F.col(doc), F.xxhash64(text), "_row")
    firsts = found.groupBy("_root").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return found.join(firsts, "_row", "left_semi").select(*plain.columns).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 1024 ids; null texts count as empty."""
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", keep_harmless),
    ("line dedup", remove_passages),
    ("simhash near-dedup", one_of_each),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each result is written as Parquet and read by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{base}/stage-{k}")
    return docs


#: The classifiers and hashes are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
