"""Tables for display and files: chromosome matrices, clone segments, denoising, panels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import AUTOSOMES
from ..functions.kernels import ward_order
from ..functions.ranks import percentiles
from ..params import Params
from ..session import written
from .m4 import weighted_median_rows


def pedestal(baseline: DataFrame) -> DataFrame:
    """One row: the median of the segments' references."""
    return baseline.agg(F.median("baseline").alias("pedestal"))


def to_ratio(cn: DataFrame) -> DataFrame:
    return cn.withColumn("value", F.exp("value"))


def chr_matrix(cn: DataFrame, segments: DataFrame, baseline: DataFrame | float | None = None) -> DataFrame:
    """cell_id, chr, value: exp of the gene-weighted mean of cn minus the reference.

    baseline: a table by segment, a table of one row (pedestal), a number or None.
    """
    rows = cn.join(F.broadcast(segments.select("segment_id", "chr", "n_genes")), "segment_id")
    if isinstance(baseline, DataFrame):
        rows = rows.join(F.broadcast(baseline), "segment_id") if "segment_id" in baseline.columns else rows.crossJoin(F.broadcast(baseline.select(F.col(baseline.columns[0]).alias("baseline"))))  # one row
    else:
        rows = rows.withColumn("baseline", F.lit(float(baseline or 0.0)))
    return rows.groupBy("cell_id", "chr").agg(F.exp(F.sum(F.col("n_genes") * (F.col("value") - F.col("baseline"))) / F.sum("n_genes")).alias("value"))


def wide_chr_matrix(m: DataFrame, order: list[str] | None = None) -> DataFrame:
    """cell_id and one column a chromosome that has segments, in canonical order."""
    have = {r[0] for r in m.select("chr").distinct().collect()}  # one row a chromosome
    order = [c for c in (order or AUTOSOMES) if c in have]
    return m.groupBy("cell_id").pivot("chr", order).agg(F.first("value")) if order else m.select("cell_id").distinct()


def center_chr_matrix(m: DataFrame) -> DataFrame:
    """value / the cell's median chromosome; rows of median 0 stay."""
    med = F.median("value").over(Window.partitionBy("cell_id"))
    return m.withColumn("med", med).select("cell_id", "chr", F.when(F.col("med") == 0, F.col("value")).otherwise(F.col("value") / F.col("med")).alias("value"))


def clone_segments(cn: DataFrame, segments: DataFrame, predictions: DataFrame, axis: DataFrame, baseline: DataFrame | None = None, order: str = "cell_id") -> DataFrame:
    """clone_ix, clone, segment_id, ID, chrom, loc.start, loc.end, num.mark, seg.mean: median of each clone's tumor cells.

    loc.end is the end of the segment's last gene. Clones come in order of their
    first tumor cell by ``order``; without any label there is one, all_tumor.
    """
    tumor = predictions.where(F.col("class") == "tumor").withColumn("subclone", F.coalesce("subclone", F.lit("")))
    labelled = tumor.agg(F.count_if(F.col("subclone") != "").alias("n_labelled"))
    named = tumor.crossJoin(F.broadcast(labelled)).where((F.col("n_labelled") == 0) | (F.col("subclone") != "")).select("cell_id", F.when(F.col("n_labelled") == 0, "all_tumor").otherwise(F.col("subclone")).alias("clone"), F.col(order).alias("o"))  # one row
    ranks = named.groupBy("clone").agg(F.min("o").alias("o")).select("clone", F.row_number().over(Window.orderBy("o")).alias("clone_ix"))
    rel = cn if baseline is None else cn.join(F.broadcast(baseline), "segment_id").select("cell_id", "segment_id", (F.col("value") - F.col("baseline")).alias("value"))
    med = percentiles(rel.join(named, "cell_id"), "value", {"m": 0.5}, ("clone", "segment_id"))
    a = axis.select(F.col("gene_ix").alias("start_idx"), F.col("chr").alias("c"), F.col("start").alias("s"))
    b = axis.select((F.col("gene_ix") + 1).alias("end_idx"), F.col("end").alias("e"))
    where = segments.select("segment_id", "start_idx", "end_idx").join(a, "start_idx").join(b, "end_idx")
    return med.join(F.broadcast(where), "segment_id").join(F.broadcast(ranks), "clone").select(
        "clone_ix", "clone", "segment_id", F.col("clone").alias("ID"), F.col("c").alias("chrom"), F.col("s").cast("long").alias("loc.start"), F.col("e").cast("long").alias("loc.end"), (F.col("end_idx") - F.col("start_idx")).cast("long").alias("num.mark"), F.col("m").alias("seg.mean")
    )


def seg_table(clones: DataFrame, sample: str) -> DataFrame:
    """The .seg columns, ID = sample::clone."""
    return clones.orderBy("clone_ix", "segment_id").select(F.concat_ws("::", F.lit(sample), "ID").alias("ID"), "chrom", "`loc.start`", "`loc.end`", "`num.mark`", "`seg.mean`")


def confident_diploid(predictions: DataFrame, quantile: float = Params.ref_score_quantile, score: str = "cn_burden") -> DataFrame:
    """cell_id of normal, not low-complexity cells whose burden is at most the pool's quantile.

    A table without ``cn_burden`` is judged by the magnitude of its tumor_score.
    """
    value = F.col(score) if score in predictions.columns else F.abs("tumor_score")
    low = F.coalesce("low_complexity", F.lit(False)) if "low_complexity" in predictions.columns else F.lit(False)
    pool = predictions.where((F.col("class") == "normal") & ~low).select("cell_id", value.alias("v"))
    cut = percentiles(pool, "v", {"q": quantile})
    return pool.crossJoin(F.broadcast(cut)).where("v <= q").select("cell_id")  # one row


def recenter(cn: DataFrame, reference: DataFrame, weights: DataFrame) -> DataFrame:
    """Minus the segment's median over the reference (all cells if it is empty), minus the cell's weighted median."""
    size = reference.agg(F.count("*").alias("pool"))
    ref = cn.join(reference.select("cell_id", F.lit(True).alias("__in")), "cell_id", "left").crossJoin(F.broadcast(size)).where((F.col("pool") == 0) | F.col("__in"))  # one row
    med = percentiles(ref, "value", {"m": 0.5}, ("segment_id",))
    rel = cn.join(F.broadcast(med), "segment_id").select("cell_id", "segment_id", (F.col("value") - F.col("m")).alias("value"))
    return rel.join(weighted_median_rows(rel, weights), "cell_id").select("cell_id", "segment_id", (F.col("value") - F.col("med")).alias("value"))


def denoise(rc: DataFrame, reference: DataFrame, amplifier: float = Params.sd_amplifier) -> DataFrame:
    """Soft threshold by 1.4826 MAD of the cleaner half of the reference, times ``amplifier``."""
    if not (amplifier >= 0 and amplifier < float("inf")):
        raise ValueError("sd_amplifier must be finite and not negative")
    if amplifier <= 0:
        return rc
    size = reference.agg(F.count("*").alias("pool"))
    inside = rc.join(reference.select("cell_id", F.lit(True).alias("__in")), "cell_id", "left").crossJoin(F.broadcast(size))  # one row
    total = inside.where("__in").groupBy("cell_id").agg(F.sum(F.abs("value")).alias("total"))
    med_total = percentiles(total, "total", {"mid": 0.5})
    clean = total.crossJoin(F.broadcast(med_total)).where("total <= mid").select("cell_id", F.lit(True).alias("__clean"))  # one row
    ref = inside.join(clean, "cell_id", "left").where((F.col("pool") == 0) | (F.col("__in") & ((F.col("pool") < 8) | F.col("__clean"))))
    mid = percentiles(ref, "value", {"m": 0.5}, ("segment_id",))
    apart = ref.join(F.broadcast(mid), "segment_id").select("segment_id", F.abs(F.col("value") - F.col("m")).alias("apart"))
    spread = percentiles(apart, "apart", {"mad": 0.5}, ("segment_id",)).select("segment_id", (1.4826 * F.col("mad")).alias("spread"))
    return rc.join(F.broadcast(spread), "segment_id").select("cell_id", "segment_id", (F.signum("value") * F.greatest(F.abs("value") - amplifier * F.col("spread"), F.lit(0.0))).alias("value"))


def reference_relative_signal(cn: DataFrame, predictions: DataFrame, segments: DataFrame, amplifier: float = Params.sd_amplifier, quantile: float = Params.ref_score_quantile) -> DataFrame:
    reference = written(confident_diploid(predictions, quantile), "diploid")
    if reference.isEmpty():
        raise ValueError("no reference cells to denoise against")
    return denoise(written(recenter(cn, reference, segments.select("segment_id", "n_genes")), "recentered"), reference, amplifier)


def genome_layout(segments: DataFrame, rank: str = "chr_rank") -> DataFrame:
    """segment_id, chr, first and last gene edge in genome order, and the chromosome's bounds and middle."""
    line = Window.orderBy(rank, "segment_id").rowsBetween(Window.unboundedPreceding, 0)
    edged = segments.withColumn("right_edge", F.sum("n_genes").over(line).cast("long")).withColumn("left_edge", F.col("right_edge") - F.col("n_genes"))
    by = Window.partitionBy("chr")
    return edged.select("segment_id", "chr", "left_edge", "right_edge", F.min("left_edge").over(by).alias("chr_left"), F.max("right_edge").over(by).alias("chr_right"), ((F.min("left_edge").over(by) + F.max("right_edge").over(by)) / 2).alias("chr_mid"))


def panel_sample(cells: DataFrame, cap: int, group: str | None = "subclone", seed: int = 0) -> DataFrame:
    """At most about ``cap`` cells, in proportion by group and at least one of each; a display panel, drawn by hash."""
    key = F.xxhash64(F.lit(seed), "cell_id")
    by = Window.partitionBy(group) if group else Window.partitionBy()
    total = cells.agg(F.count("*").alias("all_n"))
    sized = cells.crossJoin(F.broadcast(total)).withColumn("own_n", F.count("*").over(by))  # one row
    quota = F.when(F.col("all_n") <= cap, F.col("own_n")).otherwise(F.greatest(F.lit(1), F.rint(F.col("own_n") * cap / F.col("all_n"))) if group else F.lit(cap))
    order = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(key, "cell_id")
    return sized.withColumn("quota", quota).withColumn("rn", F.row_number().over(order)).where("rn <= quota").select(*cells.columns)


def panels(signal: DataFrame, predictions: DataFrame, *, n_ref: int = Params.heatmap_n_ref, max_obs: int = Params.heatmap_max_obs, quantile: float = Params.ref_score_quantile, cluster_max: int = Params.cluster_max, show_low_complexity: bool = False, seed: int = 0) -> DataFrame:
    """panel, row, cell_id, subclone, values: the rows of a heatmap in drawing order.

    References are the confident diploid cells, observations the tumor cells in
    blocks by subclone, uncertain those flagged; low-complexity cells are left out
    unless asked for. Each panel is drawn down to its cap, and each block is in
    Ward leaf order, in one group: its size is the cap's.
    """
    value = F.col("cn_burden") if "cn_burden" in predictions.columns else F.abs("tumor_score")
    low = F.coalesce("low_complexity", F.lit(False)) if "low_complexity" in predictions.columns else F.lit(False)
    calls = predictions.select("cell_id", "class", F.coalesce("subclone", F.lit("")).alias("subclone"), low.alias("low"), value.alias("v"))
    cut = percentiles(calls.where((F.col("class") == "normal") & ~F.col("low")), "v", {"q": quantile})
    plotted = calls.crossJoin(F.broadcast(cut)).where(F.lit(show_low_complexity) | ~F.col("low"))  # one row
    shown = lambda which, name, cap, group: panel_sample(plotted.where(which).select("cell_id", "subclone"), cap, group, seed).select(F.lit(name).alias("panel"), "cell_id", F.col("subclone") if group else F.lit("").alias("subclone"))
    rows = shown((F.col("class") == "normal") & (F.col("v") <= F.col("q")), "references", n_ref, None)
    rows = rows.unionByName(shown(F.col("class") == "tumor", "observations", max_obs, "subclone")).unionByName(shown(F.col("class") == "uncertain", "uncertain", n_ref, None))
    arrays = signal.join(F.broadcast(rows.select("cell_id")), "cell_id").groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "value"))), lambda x: x["value"]).alias("values"))
    kind = predictions.schema["cell_id"].dataType.simpleString()

    def ordered(pdf):
        pdf = pdf.sort_values("cell_id").reset_index(drop=True)
        pdf = pdf.iloc[ward_order(np.array(pdf["values"].tolist(), float).reshape(len(pdf), -1), cluster_max)]
        return pdf.assign(place=range(len(pdf)))

    block = rows.join(arrays, "cell_id").select("panel", "subclone", "cell_id", "values").groupBy("panel", "subclone").applyInPandas(ordered, f"panel string, subclone string, cell_id {kind}, values array<double>, place int")
    line = F.row_number().over(Window.partitionBy("panel").orderBy("subclone", "place")) - 1
    return block.select("panel", line.alias("row"), "cell_id", "subclone", "values")


def group_runs(rows: DataFrame, group: str, order: str) -> DataFrame:
    """group, first, last: contiguous runs of a group in row order."""
    line = Window.orderBy(order)
    marked = rows.withColumn("row", F.row_number().over(line) - 1).withColumn("new", (F.lag(group).over(line).isNull() | (F.lag(group).over(line) != F.col(group))).cast("int")).withColumn("run", F.sum("new").over(line))
    return marked.groupBy("run", group).agg(F.min("row").alias("first"), F.max("row").alias("last")).select(group, "first", "last")


def heatmap_values(m: DataFrame) -> DataFrame:
    """log2 of a chromosome matrix, floored at 1e-6."""
    return m.withColumn("value", F.log2(F.greatest("value", F.lit(1e-6))))
