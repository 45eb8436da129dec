"""Queries over the tables of sf_dir for the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm import decontaminate, exact_dedup, language_id, licenses, near_dedup, packing, pii, substring_dedup, suffix_dedup, toxicity
from mediaspark.llm.common import crc_mod


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out")
    return language_id.predict(docs.select("doc_id", "text"), language_id.train(docs)).select("doc_id", held_out, "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out, "score", "predicted")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(_table(spark, sf_dir, "documents"), near_dedup.Limit(k=3, num=85, den=100))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.passages(_table(spark, sf_dir, "documents"))


_ALL = (op1_license_scan, op2_pii_spans, op3_language_id, op4_exact_dedup, op5_substring_dedup, op6_best_fit_packing,
        op7_benchmark_decontamination, op8_toxicity, op9_minhash_near_dedup, op10_suffix_array_dedup)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE = {
    "op7_benchmark_decontamination": decontaminate.SQL,
    "op4_exact_dedup": """
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
               sha256(coalesce(d.text, '')) AS text_sha256
        FROM documents d
        JOIN (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS group_size
              FROM documents GROUP BY 1) g ON coalesce(d.text, '') = g.t""",
}
