"""The corpus pipeline: documents through five of the operators, each stage written as Parquet and read again.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaspark.llm import common, decontaminate, exact_dedup, language_id, near_dedup, packing


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those that are rejected as of none (without text or without a letter) go. Learned from docs itself; where nothing can be learned, all with a letter stay."""
    model = language_id.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    scored = language_id.predict(docs, model)
    return scored.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by sets of five-word shingles of similarity 0.8 or more, the smallest doc_id stays."""
    return near_dedup.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]

#: Language ID and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = common.stage(docs, "pipeline")
    return docs
