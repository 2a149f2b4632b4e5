"""The training-data pipeline over ``documents``: each stage reads what the one before wrote.

1. quality rules: documents that the cascade rejects go.
2. MinHash near-dedup: the least document of each near-duplicate class stays.
3. substring dedup: words inside repeated 35-word windows are cut out of the texts.
4. benchmark decontamination: documents that hold a benchmark item go.
5. SentencePiece encoding: the pieces of every document that is left.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kbspark.llm import decontaminate, near_dedup, quality_rules, sentencepiece_viterbi, substring_dedup
from kbspark.llm.queries import PIECES
from kbspark.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the shortened text; a document that loses every word stays, with an empty text."""
    out = substring_dedup.substring_dedup(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = sentencepiece_viterbi.encode(docs, public_tokenizers.path(PIECES))
    return out.select(F.col("id").alias("doc_id"), "ids", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip")


STAGES = [("quality_rules", quality), ("minhash_near_dedup", dedup), ("substring_dedup", substrings),
          ("benchmark_decontamination", benchmark), ("sentencepiece", pieces)]

#: No SQL: near-duplicate classes, tilings and Viterbi paths are beyond it; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
