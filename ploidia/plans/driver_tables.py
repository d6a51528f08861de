"""The driver's tables read as single-cell data.

A supplier is a cell, (brand, size) of a part a gene on chromosome ``brand`` at
position ``size``, the summed quantity of line items its count; suppliers of
regions 0-2 are the reference. ``embeddings`` is a ready matrix of 64 segments
on 8 chromosomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import m1, m3, m4
from ..params import Params
from ..session import written

PARAMS = Params(min_genes=100)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank(brand):
    return F.regexp_extract(brand, r"(\d+)$", 1).cast("int")


def counts(spark: SparkSession, d: str) -> DataFrame:
    li, part = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity"), table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    gene = F.concat_ws("-", "p_brand", "p_size").alias("gene")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("cell_id"), gene).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("cell_id"), F.col("n_regionkey").cast("int").alias("region"), (F.col("n_regionkey") <= 2).alias("is_ref"))


def genes(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "part").select("p_brand", F.col("p_size").cast("long").alias("p_size")).distinct()
    return g.select(F.concat_ws("-", "p_brand", "p_size").alias("gene"), F.col("p_brand").alias("chr"), rank(F.col("p_brand")).alias("chr_rank"), (F.col("p_size") * 10).alias("start"), (F.col("p_size") * 10 + (F.col("p_size") * 7) % 23).alias("end"), (rank(F.col("p_brand")).cast("long") * 1000 + F.col("p_size")).alias("orig_ix"))


def gene_order(spark: SparkSession, d: str) -> DataFrame:
    return genes(spark, d).select(F.col("gene").alias("gene_symbol"), "chr", "chr_rank", "start", "end")


def filtered(spark: SparkSession, d: str):
    """(values, kept cells, gene axis), each written once, as a run writes them."""
    found = m1.filter_normalize_project(written(counts(spark, d), "counts"), cells(spark, d), genes(spark, d).select("gene", "orig_ix"), gene_order(spark, d), params=PARAMS)
    return tuple(written(df, name) for df, name in zip(found, ("values", "kept", "axis"), strict=True))


def profiles(spark: SparkSession, d: str):
    """(values, cells, axis, medians, tiles, cn) with one segment a chromosome."""
    values, kept, axis = filtered(spark, d)
    med = written(m3.gene_medians(values, kept, axis), "medians")
    tiles = written(m3.chromosome_tiles(axis), "tiles")
    cn = written(m3.segment_cn(values, kept, tiles, m3.segment_kernel(axis, tiles), med), "cn")
    return values, kept, axis, med, tiles, cn


def matrix(spark: SparkSession, d: str):
    """(cn, cells, segments) of ``embeddings``."""
    e = table(spark, d, "embeddings")
    cn = e.select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("segment_id", "v")).select("cell_id", "segment_id", F.col("v").cast("double").alias("value"))
    own = e.select(F.col("vec_id").alias("cell_id"), (F.col("label") < 5).alias("is_ref"), F.col("label").cast("int").alias("label"))
    s = spark.range(64).select(F.col("id").cast("int").alias("segment_id"))
    s = s.select("segment_id", F.concat(F.lit("chr"), F.floor(F.col("segment_id") / 8) + 1).alias("chr"), F.floor(F.col("segment_id") / 8).cast("int").alias("chr_rank"), (25 + F.col("segment_id") % 4 * 10).cast("int").alias("n_genes"))
    return cn, own, s


def scored(spark: SparkSession, d: str):
    """(dev, segments, scored cells) of ``embeddings``: score, burden, coherent, is_ref, low_complexity."""
    cn, own, segs = matrix(spark, d)
    dev = written(m4.deviation(cn, m3.reference_baseline(cn, own), segs), "deviation")
    b = written(m4.burden(dev, segs), "burden")
    t = m4.template_of(dev, b)
    out = own.join(m4.projection(dev, t, segs), "cell_id").join(b, "cell_id").join(m4.coherent_fraction(dev, segs), "cell_id").withColumn("low_complexity", F.col("cell_id") % 11 == 0)
    return dev, segs, out


def called(spark: SparkSession, d: str):
    """Scored cells with calls by a plain cut at the 60th percentile of scores, so that gates can be held against SQL."""
    dev, segs, s = scored(spark, d)
    cut = s.agg(F.percentile("score", F.lit(0.6)).alias("cut"))
    c = s.crossJoin(F.broadcast(cut)).withColumn("class", F.when((F.col("score") > F.col("cut")) & ~F.col("is_ref"), "tumor").otherwise("normal")).withColumn("confidence", F.lit(0.5) + (F.col("cell_id") % 50) / 100.0).drop("cut")  # one row
    return dev, segs, c


def predictions(spark: SparkSession, d: str):
    """(cn, segments, cells, predictions of the plain cut with label-based subclones)."""
    cn, own, segs = matrix(spark, d)
    _, _, c = called(spark, d)
    clone = F.when(F.col("class") == "tumor", F.concat(F.lit("subclone_"), (F.col("label") % 3 + 1).cast("string"))).otherwise("")
    return cn, segs, own, written(c.withColumn("subclone", clone).withColumn("cn_burden", F.col("burden")).withColumn("tumor_score", F.col("score")), "plain-cut")
