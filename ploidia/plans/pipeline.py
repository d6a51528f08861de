"""From counts to calls.

Everything between actions is one lazy plan. Actions stand only where a result
decides what comes next: which pool tier is used, where segments break, and the
one-dimensional fit.
"""

from __future__ import annotations

import io
import json
import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genome import AUTOSOMES, NON_MALIGNANT, SIGNATURES
from ..operators import m1, m2, m3, m4, outputs
from ..params import Params
from ..session import put_bytes, ship, written


@dataclass
class Result:
    """Frames of a run; qc is a plain dict."""

    predictions: DataFrame
    segments: DataFrame
    cn: DataFrame
    baseline: DataFrame
    chr_matrix: DataFrame
    cells: DataFrame
    axis: DataFrame
    qc: dict = field(default_factory=dict)


def run_pipeline(counts: DataFrame, cells: DataFrame, genes: DataFrame, gene_order: DataFrame, *, cycle: DataFrame | None = None, names: DataFrame | None = None, signatures: dict | None = None, labels: list[str] | None = None, params: Params = Params(complexity_gate=False), rules: dict | None = None) -> Result:
    """counts(cell_id, gene, value), cells(cell_id), genes(gene, orig_ix), gene_order(gene_symbol, chr, chr_rank, start, end).

    ``names`` (cell_id) supplies the reference; else ``signatures`` (None: the
    bundled library, {}: none) and the tiers after it.
    """
    spark = counts.sparkSession
    ship(spark)
    times, began = {}, time.time()

    def took(stage: str) -> None:
        nonlocal began
        times[stage], began = round(time.time() - began, 3), time.time()

    values, kept, axis = m1.filter_normalize_project(counts, cells, genes, gene_order, cycle, params, **(rules or {}))
    values, kept, axis = written(values, "values"), written(kept, "cells"), written(axis, "axis")
    n_cells, n_genes = kept.count(), axis.count()
    if n_cells == 0 or n_genes == 0:
        raise ValueError(f"nothing left after filtering: {n_cells} cells, {n_genes} genes")
    took("m1")
    library, allowed = (SIGNATURES, NON_MALIGNANT) if signatures is None else (signatures, labels)
    pooled_cells, pool = m2.pick_pool(values, kept, axis, names=names, signatures=library, labels=allowed, params=params)
    pooled_cells = written(pooled_cells, "reference")
    took("m2")
    medians = written(m3.gene_medians(values, pooled_cells, axis), "medians")
    signal = m3.pooled_signal(values, pooled_cells, axis, medians, params.smooth_window)
    segments = written(m3.segments_from_pooled(signal, axis, params.penalty_coef, params.min_seg_genes), "segments")
    kernel = m3.segment_kernel(axis, segments, params.smooth_window)
    cn = written(m3.segment_cn(values, pooled_cells, segments, kernel, medians), "cn")
    base = written(m3.reference_baseline(cn, pooled_cells), "baseline")
    segments = m3.center_tumor_mean(segments, base)
    took("m3")
    n_segments = segments.count()
    if n_segments == 0:
        raise ValueError("no chromosome has enough genes for a segment")
    detected = m1.detected_genes(values, pooled_cells)
    predictions, counters = m4.classify_cells(cn, segments, pooled_cells, detected, params)
    predictions = written(predictions, "predictions")
    took("m4")
    matrix = outputs.chr_matrix(cn, segments, outputs.pedestal(base))
    facts = segments.agg(F.max(F.abs("tumor_mean")).alias("m"), F.median("n_genes").alias("g")).first()
    qc = {
        "n_cells": n_cells, "n_genes": n_genes, "n_segments": n_segments, "baseline_method": pool["method"], "n_normal_reference": pool["n_normal"], "baseline_diagnostics": pool["diagnostics"],
        "class_counts": {r[0]: r[1] for r in predictions.groupBy("class").count().collect()},
        "subclone_counts": {r[0]: r[1] for r in predictions.where("subclone <> ''").groupBy("subclone").count().collect()},
        "segments_per_chromosome": {r[0]: r[1] for r in segments.groupBy("chr").count().collect()},
        "tumor_signal_max_abs": facts["m"], "median_segment_genes": facts["g"], **counters, "seconds": times, "params": {k: v for k, v in vars(params).items()},
    }
    return Result(predictions, segments, cn, base, matrix, pooled_cells, axis, qc)


def matches(column: Column, categories: list) -> Column:
    """Native or textual equality."""
    return column.cast("string").isin(*[str(c) for c in categories])


def call_cnv(counts: DataFrame, cells: DataFrame, genes: DataFrame, gene_order: DataFrame, *, reference_key: str | None = None, reference_cat=None, key_added: str = "cnv", params: Params = Params(), **how) -> tuple[DataFrame, dict]:
    """(all input cells with the results beside them, NULL where filtered; qc).

    Adds <key>_class, <key>_score, <key>_cn_burden, <key>_subclone,
    <key>_low_complexity and <key>_chr (map of chromosome to value).
    """
    if cells.groupBy("cell_id").count().where("count > 1").limit(1).count():
        raise ValueError("cell ids are not unique")
    names = None
    if reference_key is not None:
        if reference_key not in cells.columns:
            raise ValueError(f"no column {reference_key}")
        cats = list(reference_cat) if isinstance(reference_cat, (list, tuple, set)) else [reference_cat]
        present = {r[0] for r in cells.select(F.col(reference_key).cast("string")).distinct().collect()}
        if missing := [c for c in cats if str(c) not in present]:
            raise ValueError(f"{reference_key} has no {missing}")
        names = cells.where(matches(F.col(reference_key), cats)).select("cell_id")
    r = run_pipeline(counts, cells, genes, gene_order, names=names, params=params, **how)
    k = key_added
    p = r.predictions.select("cell_id", F.col("class").alias(f"{k}_class"), F.col("tumor_score").alias(f"{k}_score"), F.col("cn_burden").alias(f"{k}_cn_burden"), F.col("subclone").alias(f"{k}_subclone"), F.col("low_complexity").alias(f"{k}_low_complexity"))
    by_chr = r.chr_matrix.groupBy("cell_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chr", "value")))).alias(f"{k}_chr"))
    return cells.join(p, "cell_id", "left").join(by_chr, "cell_id", "left"), r.qc


def npz_of(arrays: DataFrame, **more) -> bytes:
    """A numpy archive of a table (cell_id, cn): ``cn`` and ``cell_barcodes``, by barcode. All rows come to the driver."""
    t = arrays.select(F.col("cell_id").cast("string").alias("cell_id"), "cn").orderBy("cell_id").toArrow()
    names = np.array(t.column("cell_id").to_pylist(), dtype=str)
    flat = t.column("cn").combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.zeros(0)
    held = io.BytesIO()
    np.savez_compressed(held, cn=flat.reshape(len(names), len(flat) // max(1, len(names))).astype(np.float32), cell_barcodes=names, **more)
    return held.getvalue()


def write_run(r: Result, out_dir: str, sample: str = "sample", centered: bool = False, denoised: bool = False, amplifier: float = Params.sd_amplifier, npz_cells: int = 200_000) -> None:
    """The run's tables as Parquet, plus CSV and .seg directories for other tools, and qc.json; up to ``npz_cells`` cells as numpy archives too."""
    spark = r.predictions.sparkSession
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{out_dir}/{name}.parquet")
    csv = lambda df, name, sep=",": df.coalesce(1).write.mode("overwrite").csv(f"{out_dir}/{name}", header=True, sep=sep)
    ordered = r.predictions.select(F.col("cell_id").alias("barcode"), "class", "confidence", "tumor_score", "subclone", "n_segments_altered", "low_complexity", "cn_burden").orderBy("barcode")
    put(ordered, "prediction")
    csv(ordered, "prediction.csv")
    put(r.segments.orderBy("segment_id"), "segments")
    arrays = lambda df: df.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "value"))), lambda x: x["value"]).alias("cn"))
    put(arrays(r.cn), "cn_per_segment")
    n_cells = r.qc["n_cells"]
    if n_cells <= npz_cells:
        put_bytes(spark, f"{out_dir}/cn_per_segment.npz", npz_of(spark.read.parquet(f"{out_dir}/cn_per_segment.parquet")))
    csv(outputs.wide_chr_matrix(r.chr_matrix, AUTOSOMES).withColumnRenamed("cell_id", "barcode").orderBy("barcode"), "chr_cnv_matrix.csv")
    if centered:
        csv(outputs.wide_chr_matrix(outputs.center_chr_matrix(r.chr_matrix), AUTOSOMES).withColumnRenamed("cell_id", "barcode").orderBy("barcode"), "chr_cnv_matrix_centered.csv")
    csv(outputs.seg_table(outputs.clone_segments(r.cn, r.segments, r.predictions, r.axis, r.baseline), sample), "clones.seg", "\t")
    if denoised:
        put(arrays(outputs.reference_relative_signal(r.cn, r.predictions, r.segments, amplifier)), "cn_per_segment_denoised")
        if n_cells <= npz_cells:
            put_bytes(spark, f"{out_dir}/cn_per_segment_denoised.npz", npz_of(spark.read.parquet(f"{out_dir}/cn_per_segment_denoised.parquet"), sd_amplifier=amplifier))
    put_bytes(spark, f"{out_dir}/qc.json", json.dumps(r.qc, indent=1, default=str).encode())
