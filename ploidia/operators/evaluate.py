"""Scores of calls against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """One row, auc: rank-sum statistic with tied ranks averaged. Ranks come from counts by distinct score, so rows are never sorted in one task."""
    by = df.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    # negatives below each distinct score, by ranges of scores: sums of ranges first, then within
    lanes = 256
    bounds = by.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    at = F.least(F.lit(lanes - 1), F.floor(F.try_divide(F.col(score) - F.col("lo"), F.col("hi") - F.col("lo")) * lanes))
    laned = by.crossJoin(F.broadcast(bounds)).withColumn("lane", F.coalesce(at, F.lit(0)).cast("int"))  # one row
    sums = laned.groupBy("lane").agg(F.sum("q").alias("n"))
    before = sums.select("lane", F.coalesce(F.sum("n").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))  # at most 256 rows
    inner = F.coalesce(F.sum("q").over(Window.partitionBy("lane").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = laned.withColumn("below", inner).join(F.broadcast(before), "lane")
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("base") + F.col("below") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))


def recalls(df: DataFrame, call: str = "class", truth: str = "is_tumor") -> DataFrame:
    """tumor_recall, normal_recall, false_tumor_rate."""
    t = F.col(truth)
    return df.agg(
        F.avg(F.when(t, (F.col(call) == "tumor").cast("double"))).alias("tumor_recall"),
        F.avg(F.when(~t, (F.col(call) == "normal").cast("double"))).alias("normal_recall"),
        F.avg(F.when(~t, (F.col(call) == "tumor").cast("double"))).alias("false_tumor_rate"),
    )


def direction_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of altered regions (region, level) whose found value has the level's sign."""
    return truth.where("level <> 0").join(found, "region").agg(F.avg((F.signum("value") == F.signum("level")).cast("double")).alias("direction_recall"))


def bulk_correlation(profile: DataFrame, bulk: DataFrame) -> DataFrame:
    """Pearson correlation of the median-centred log2 pseudobulk with bulk, by region. NaN if either side is the same in all regions, null without regions."""
    log = profile.select("region", F.log2(F.greatest("value", F.lit(1e-6))).alias("x"))
    med = log.agg(F.median("x").alias("m"))
    both = log.crossJoin(F.broadcast(med)).join(bulk.select("region", F.col("value").alias("y")), "region")  # one row
    pairs = both.select((F.col("x") - F.col("m")).alias("x"), "y").where("x is not null and y is not null")
    # the built-in correlation divides by a spread of zero, which is an error in ANSI mode
    r = F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x")) * F.sqrt(F.var_pop("y")))
    return pairs.agg(F.coalesce(r, F.when(F.count("*") > 0, F.lit(float("nan")))).alias("pearson"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n, and subtotals by rollup."""
    return df.rollup(a, b).agg(F.count("*").alias("n"))


def pseudobulk(cn: DataFrame, calls: DataFrame, segments: DataFrame) -> DataFrame:
    """class, chr, value: gene-weighted mean over the cells of a class."""
    rows = cn.join(calls.select("cell_id", "class"), "cell_id").join(F.broadcast(segments.select("segment_id", "chr", "n_genes")), "segment_id")
    return rows.groupBy("class", "chr").agg((F.sum(F.col("value") * F.col("n_genes")) / F.sum("n_genes")).alias("value"))


def locus_segments(loci: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments that cover each locus (locus, chr, pos)."""
    return loci.join(F.broadcast(segments.select("segment_id", "chr", "start_bp", "end_bp")), "chr").where("pos between start_bp and end_bp").select("locus", "segment_id")
