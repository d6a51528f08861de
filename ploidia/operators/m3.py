"""Centre, smooth, segment.

Centring, smoothing and segment means are linear in the values, so a cell's
segment mean is a weighted sum of its non-zero values minus a constant of the
segment: nothing is made dense. The weights are a table over the gene axis.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import segment_chromosome, smoothing_matrix, smoothing_width
from ..functions.ranks import percentiles
from ..params import Params
from ..schemas import SEGMENTS


def reference_cells(cells: DataFrame) -> DataFrame:
    """The reference pool (is_ref), or all cells if it is empty."""
    size = cells.agg(F.count_if("is_ref").alias("pool"))
    return cells.crossJoin(F.broadcast(size)).where((F.col("pool") == 0) | F.col("is_ref")).select("cell_id")  # one row


def gene_medians(values: DataFrame, cells: DataFrame, axis: DataFrame) -> DataFrame:
    """gene_ix, med: exact median over the reference pool, implicit zeros included.

    Equal values are counted where they are, and ranks run along each gene's
    distinct values in order, so no gene's values are held at once. Zeros, stored
    or not, lie between the negative and the positive values.
    """
    ref = reference_cells(cells)
    n = ref.agg(F.count("*").alias("n_ref"))
    by = values.join(ref, "cell_id", "left_semi").where("value <> 0").groupBy("gene_ix", "value").agg(F.count("*").alias("c"))
    line = Window.partitionBy("gene_ix").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.withColumn("before", F.coalesce(F.sum("c").over(line), F.lit(0)))
    nnz = by.groupBy("gene_ix").agg(F.sum("c").alias("nnz"))
    placed = ranked.join(F.broadcast(nnz), "gene_ix").crossJoin(F.broadcast(n))  # a row a gene; one row
    start = F.col("before") + F.when(F.col("value") > 0, F.col("n_ref") - F.col("nnz")).otherwise(F.lit(0))
    at = lambda rank: F.max(F.when((start <= F.expr(rank)) & (F.expr(rank) < start + F.col("c")), F.col("value")))
    found = placed.groupBy("gene_ix").agg(at("(n_ref - 1) div 2").alias("lo"), at("n_ref div 2").alias("hi"))
    return axis.select("gene_ix").join(found, "gene_ix", "left").select("gene_ix", ((F.coalesce("lo", F.lit(0.0)) + F.coalesce("hi", F.lit(0.0))) / 2).alias("med"))


def centered(values: DataFrame, cells: DataFrame, axis: DataFrame, medians: DataFrame) -> DataFrame:
    """Every (cell, gene): value minus the gene's reference median. Dense; the linear path doesn't need it."""
    every = cells.select("cell_id").crossJoin(medians.select("gene_ix", "med"))
    return every.join(values, ["cell_id", "gene_ix"], "left").select("cell_id", "gene_ix", (F.coalesce("value", F.lit(0.0)) - F.col("med")).alias("value"))


def smoothed(signal: DataFrame, axis: DataFrame, key: list[str], window: int = Params.smooth_window) -> DataFrame:
    """Moving average along each chromosome, ends repeated; ``key`` names what a profile belongs to."""
    sizes = axis.groupBy("chr").agg(F.count("*").cast("int").alias("n"), F.min("gene_ix").alias("base"))
    placed = signal.join(F.broadcast(axis.select("gene_ix", "chr").join(sizes, "chr")), "gene_ix").withColumn("i", F.col("gene_ix") - F.col("base"))
    # frame bounds are literals: one plan for each of the few widths
    widths = sorted({smoothing_width(r["n"], window) for r in sizes.select("n").distinct().collect()})  # one row a chromosome
    wide = F.greatest(F.lit(10), F.least(F.lit(window), F.floor(F.col("n") / 3) + 1)).cast("int")
    line = Window.partitionBy(*key, "chr").orderBy("i")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("value").over(every), F.last("value").over(every)
    out = F.lit(None).cast("double")
    for w in widths:
        left, right = w // 2, w - w // 2 - 1
        total = F.sum("value").over(line.rowsBetween(-left, right)) + F.greatest(F.lit(0), left - F.col("i")) * first + F.greatest(F.lit(0), F.col("i") + right - (F.col("n") - 1)) * last
        out = F.when(F.col("width") == w, total / w).otherwise(out)
    return placed.withColumn("width", wide).select(*key, "gene_ix", out.alias("value"))


def pooled_signal(values: DataFrame, cells: DataFrame, axis: DataFrame, medians: DataFrame, window: int = Params.smooth_window) -> DataFrame:
    """gene_ix, value: mean smoothed signal over non-reference cells (all if none). Mean and smoothing commute, so one row a gene is smoothed."""
    size = cells.agg(F.count_if(~F.col("is_ref")).alias("others"))
    pool = cells.crossJoin(F.broadcast(size)).where((F.col("others") == 0) | ~F.col("is_ref")).select("cell_id")  # one row
    n = pool.agg(F.count("*").alias("n"))
    sums = values.join(pool, "cell_id", "left_semi").groupBy("gene_ix").agg(F.sum("value").alias("s"))
    mean = medians.join(sums, "gene_ix", "left").crossJoin(F.broadcast(n)).select(F.lit(0).alias("one"), "gene_ix", (F.coalesce("s", F.lit(0.0)) / F.greatest("n", F.lit(1)) - F.col("med")).alias("value"))
    return smoothed(mean, axis, ["one"], window).select("gene_ix", "value")


def segments_from_pooled(pooled: DataFrame, axis: DataFrame, penalty_coef: float = Params.penalty_coef, min_seg_genes: int = Params.min_seg_genes) -> DataFrame:
    """Segments of each chromosome, in genome order; tumor_mean is the pooled mean, not yet centred."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gene_ix")
        x, base = pdf["value"].to_numpy(), int(pdf["gene_ix"].iloc[0]) if len(pdf) else 0
        rows = [(pdf["chr"].iloc[0], base + a, base + b, b - a, float(x[a:b].mean())) for a, b in segment_chromosome(x, penalty_coef, min_seg_genes)]
        return pd.DataFrame(rows, columns=["chr", "start_idx", "end_idx", "n_genes", "tumor_mean"])

    line = pooled.join(axis.select("gene_ix", "chr"), "gene_ix")
    found = line.groupBy("chr").applyInPandas(run, "chr string, start_idx int, end_idx int, n_genes int, tumor_mean double")
    return with_coordinates(found, axis)


def chromosome_tiles(axis: DataFrame) -> DataFrame:
    """One segment for each whole chromosome."""
    found = axis.groupBy("chr").agg(F.min("gene_ix").alias("start_idx"), (F.max("gene_ix") + 1).cast("int").alias("end_idx"), F.count("*").cast("int").alias("n_genes")).withColumn("tumor_mean", F.lit(0.0))
    return with_coordinates(found, axis)


def with_coordinates(segments: DataFrame, axis: DataFrame) -> DataFrame:
    """Adds segment_id in genome order, least start and greatest end of the segment's genes."""
    numbered = segments.withColumn("segment_id", (F.row_number().over(Window.orderBy("start_idx")) - 1).cast("int"))
    spans = numbered.alias("s").join(axis.alias("g"), (F.col("g.gene_ix") >= F.col("s.start_idx")) & (F.col("g.gene_ix") < F.col("s.end_idx"))).groupBy("segment_id").agg(F.min("g.start").alias("start_bp"), F.max("g.end").alias("end_bp"))
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    return numbered.join(spans, "segment_id", "left").select(*names)


def segment_kernel(axis: DataFrame, segments: DataFrame, window: int = Params.smooth_window) -> DataFrame:
    """segment_id, gene_ix, k: weight of a gene's value in a segment's mean of smoothed values. Bounded by the gene axis."""
    genes = axis.select("chr", "gene_ix").toPandas().sort_values("gene_ix")
    segs = segments.select("segment_id", "chr", "start_idx", "end_idx").toPandas()
    rows = []
    for chrom, own in genes.groupby("chr", sort=False):
        base, k = int(own["gene_ix"].min()), smoothing_matrix(len(own), window)
        for s in segs[segs["chr"] == chrom].itertuples():
            w = k[s.start_idx - base : s.end_idx - base].mean(0)
            rows += [(int(s.segment_id), base + int(i), float(w[i])) for i in np.flatnonzero(w)]
    return axis.sparkSession.createDataFrame(rows, "segment_id int, gene_ix int, k double")


def segment_cn(values: DataFrame, cells: DataFrame, segments: DataFrame, kernel: DataFrame, medians: DataFrame) -> DataFrame:
    """cell_id, segment_id, value for all cells and segments, by the linear path: one shuffle by (cell, segment)."""
    base = kernel.join(medians, "gene_ix").groupBy("segment_id").agg(F.sum(F.col("k") * F.col("med")).alias("base"))
    sums = values.join(F.broadcast(kernel), "gene_ix").groupBy("cell_id", "segment_id").agg(F.sum(F.col("value") * F.col("k")).alias("s"))
    every = cells.select("cell_id").crossJoin(F.broadcast(segments.select("segment_id").join(base, "segment_id", "left")))
    return every.join(sums, ["cell_id", "segment_id"], "left").select("cell_id", "segment_id", (F.coalesce("s", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))).alias("value"))


def segment_means(signal: DataFrame, segments: DataFrame, axis: DataFrame) -> DataFrame:
    """The same from a smoothed signal: segments are resolved on the gene axis, then an equi-join."""
    of = axis.select("gene_ix").alias("g").join(F.broadcast(segments.alias("s")), (F.col("g.gene_ix") >= F.col("s.start_idx")) & (F.col("g.gene_ix") < F.col("s.end_idx"))).select("g.gene_ix", "s.segment_id")
    return signal.join(F.broadcast(of), "gene_ix").groupBy("cell_id", "segment_id").agg(F.avg("value").alias("value"))


def reference_baseline(cn: DataFrame, cells: DataFrame) -> DataFrame:
    """segment_id, baseline: median over the reference pool."""
    return percentiles(cn.join(reference_cells(cells), "cell_id", "left_semi"), "value", {"baseline": 0.5}, ("segment_id",))


def center_tumor_mean(segments: DataFrame, baseline: DataFrame) -> DataFrame:
    names = segments.columns
    return segments.join(baseline, "segment_id", "left").withColumn("tumor_mean", F.col("tumor_mean") - F.coalesce("baseline", F.lit(0.0))).select(*names)


def block_rows(n_genes: int, target_bytes: float = Params.block_bytes) -> int:
    """Rows of a dense block of about ``target_bytes`` of 4-byte values; sizes Arrow batches."""
    return max(1, int(target_bytes // (4 * max(n_genes, 1))))
