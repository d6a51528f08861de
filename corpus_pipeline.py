"""A corpus from raw documents to token ids: five stages, each one of the operators.

1. quality   documents that the classifier rejects go
2. exact     of equal texts the one with the largest doc_id stays
3. near      of each SimHash group the document with the smallest doc_id stays
4. mix       sources come near their target weights, in whole documents
5. encode    token ids and the text they decode to, as digests

Every stage reads all that the one before kept, as a written table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ploidia.llm import bpe, exact_dedup, mixing, near_copies, quality
from ploidia.llm.shared import staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller blocks than the operator takes by itself: here the executors have four stages behind them
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decode_documents(bpe.encode_documents(docs, path, block_bytes=3 << 20), path)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mixing_stage), ("encode", encoding_stage)]

#: The classifier, the fingerprints and the draws are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
