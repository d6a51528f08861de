"""Cells, genes, normalisation and genome order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.genome import placeable
from ..params import Params


def cell_filter(counts: DataFrame, cells: DataFrame, min_genes: int = Params.min_genes) -> DataFrame:
    """Cells with at least ``min_genes`` genes above zero; n_genes is kept."""
    n = counts.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n_genes"))
    return cells.join(n, "cell_id", "left").withColumn("n_genes", F.coalesce("n_genes", F.lit(0)).cast("long")).where(F.col("n_genes") >= min_genes)


def gene_filter(counts: DataFrame, kept_cells: DataFrame, genes: DataFrame, min_cells: int = Params.min_cells, low_dr: float = Params.low_dr, up_dr: float = Params.up_dr) -> DataFrame:
    """Genes detected in enough of the kept cells, bounds included; n_cells is kept."""
    n = counts.join(kept_cells.select("cell_id"), "cell_id", "left_semi").groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n_cells"))
    total = kept_cells.agg(F.greatest(F.count("*"), F.lit(1)).alias("total_cells"))
    rate = F.col("n_cells") / F.col("total_cells")
    return (
        genes.join(n, "gene", "left")
        .withColumn("n_cells", F.coalesce("n_cells", F.lit(0)).cast("long"))
        .crossJoin(F.broadcast(total))  # one row
        .where((F.col("n_cells") >= min_cells) & (rate >= low_dr) & (rate <= up_dr))
        .drop("total_cells")
    )


def first_names(genes: DataFrame, order: str = "orig_ix") -> DataFrame:
    """Genes under their first occurrence; later ones would get suffixes that no gene order has."""
    n = F.row_number().over(Window.partitionBy("gene").orderBy(order))
    return genes.withColumn("__n", n).where("__n = 1").drop("__n")


def normalize_log1p(counts: DataFrame, target_sum: float = Params.target_sum) -> DataFrame:
    """log1p(value * target / total of the cell); a table with any negative value passes unchanged."""
    totals = counts.groupBy("cell_id").agg(F.sum("value").alias("total"), F.min("value").alias("least"))
    lowest = totals.agg(F.coalesce(F.min("least"), F.lit(0.0)).alias("lowest"))
    scaled = F.log1p(F.col("value") * target_sum / F.when(F.col("total") == 0, 1.0).otherwise(F.col("total")))
    placed = counts.join(totals.select("cell_id", "total"), "cell_id").crossJoin(F.broadcast(lowest))  # one row
    return placed.select("cell_id", "gene", F.when(F.col("lowest") < 0, F.col("value")).otherwise(scaled).alias("value"))


def gene_mask(genes: DataFrame, gene_order: DataFrame, cycle: DataFrame | None = None, **rules) -> DataFrame:
    """genes with chr, chr_rank, start, end where a gene may be used; ``rules`` as in ``placeable``."""
    placed = genes.join(gene_order.withColumnRenamed("gene_symbol", "gene"), "gene").where(placeable(F.col("gene"), F.col("chr"), **rules))
    return placed if cycle is None else placed.join(cycle.select(F.col("symbol").alias("gene")), "gene", "left_anti")


def genome_order(placed: DataFrame, tie: str = "orig_ix") -> DataFrame:
    """Adds gene_ix, the 0-based position by (chr_rank, start). The gene axis only, so one sort is fine."""
    return placed.withColumn("gene_ix", (F.row_number().over(Window.orderBy("chr_rank", "start", tie)) - 1).cast("int"))


def project(counts: DataFrame, axis: DataFrame) -> DataFrame:
    """cell_id, gene_ix, value for genes on the axis."""
    return counts.join(axis.select("gene", "gene_ix"), "gene").select("cell_id", "gene_ix", "value")


def filter_normalize_project(counts: DataFrame, cells: DataFrame, genes: DataFrame, gene_order: DataFrame, cycle: DataFrame | None = None, params: Params = Params(), target_sum: float | None = None, **rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, kept cells, gene axis): filter, then normalise by what survives, then project."""
    kept = cell_filter(counts, cells, params.min_genes)
    found = gene_filter(counts, kept, genes, params.min_cells, params.low_dr, params.up_dr)
    inner = counts.join(kept.select("cell_id"), "cell_id", "left_semi").join(found.select("gene"), "gene", "left_semi")
    axis = genome_order(gene_mask(first_names(found), gene_order, cycle, **rules))
    return project(normalize_log1p(inner, target_sum or params.target_sum), axis), kept, axis


def detected_genes(values: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, detected: number of genes whose value is not zero."""
    n = values.groupBy("cell_id").agg(F.count_if(F.col("value") != 0).alias("detected"))
    return cells.select("cell_id").join(n, "cell_id", "left").select("cell_id", F.coalesce("detected", F.lit(0)).cast("long").alias("detected"))
