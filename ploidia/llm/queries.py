"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, line_dedup, lm_scoring, mixing, quality, simhash, suffix_dedup, token_store

ABC = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(_documents(spark, sf_dir), length=50)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_common_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"), F.char_length("kept").cast("long").alias("kept_chars"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(_documents(spark, sf_dir))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_documents(spark, sf_dir), k=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)

    def digest(batches):
        for b in batches:
            ids = b.column(3)
            flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[s:e].tobytes()) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.array(crc, np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return token_store.read_documents(store).mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_documents(spark, sf_dir)).taken().select("doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.decode_documents(bpe.encode_documents(_documents(spark, sf_dir), path), path)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_line_dedup": op4_line_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_token_store": op8_token_store,
        "op9_mixing": op9_mixing,
        "op10_bpe": op10_bpe,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), {ABC}) AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
            FROM n WINDOW same AS (PARTITION BY t)""",
    }
