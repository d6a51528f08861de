"""Wall time of whole runs by number of cells: mean and standard deviation over seeded cohorts; prints a JSON line a size.

    python scaling.py 5000 50000 --replicates 3 --cpus 8

A cohort has 6,000 genes on 22 chromosomes and about 600 of them in each cell; half
of the cells are tumor, with chromosome 7 gained and chromosome 10 lost. It is
written first, and a run is timed from its tables to the written calls.
"""

from __future__ import annotations

import argparse
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

GENES, DETECTED = 6000, 600


def cohort(spark, n: int, seed: int):
    """(counts, cells, genes, gene order) of ``n`` cells."""
    from pyspark.sql import functions as F

    chrom = (F.col("j") * 22 / GENES).cast("int") + 1
    genes = spark.range(GENES).select(F.concat(F.lit("g"), "id").alias("gene"), F.col("id").alias("orig_ix"))
    order = spark.range(GENES).withColumnRenamed("id", "j").select(F.concat(F.lit("g"), "j").alias("gene_symbol"), F.concat(F.lit("chr"), chrom).alias("chr"), (chrom - 1).cast("int").alias("chr_rank"), (F.col("j") * 1000).alias("start"), (F.col("j") * 1000 + 500).alias("end"))
    cells = spark.range(n).select(F.concat(F.lit("c"), "id").alias("cell_id"), (F.col("id") % 2 == 0).alias("normal"))
    drawn = spark.range(n).withColumnRenamed("id", "c").select("c", F.explode(F.sequence(F.lit(0), F.lit(DETECTED))).alias("k"))
    drawn = drawn.select("c", F.pmod(F.xxhash64(F.lit(seed), "c", "k"), F.lit(GENES)).alias("j"), (1 + F.pmod(F.xxhash64(F.lit(seed + 1), "c", "k"), F.lit(5))).alias("v"))
    tumor = F.col("c") % 2 == 1
    level = F.when(tumor & (chrom == 7), 2.0).when(tumor & (chrom == 10), 0.5).otherwise(1.0)
    counts = drawn.groupBy("c", "j").agg(F.sum("v").alias("v")).select(F.concat(F.lit("c"), "c").alias("cell_id"), F.concat(F.lit("g"), "j").alias("gene"), F.ceil(F.col("v") * level).cast("double").alias("value"))
    return counts, cells, genes, order


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("cells", type=int, nargs="+")
    p.add_argument("--replicates", type=int, default=3)
    p.add_argument("--cpus", default="8")
    p.add_argument("--memory", default="12g")
    a = p.parse_args()
    from ploidia.params import Params
    from ploidia.plans.pipeline import run_pipeline
    from ploidia.session import session, written

    spark = session("scaling", **{"spark.master": f"local[{a.cpus}]", "spark.driver.memory": a.memory, "spark.sql.shuffle.partitions": a.cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="scaling-")})
    spark.sparkContext.setLogLevel("ERROR")

    def once(n: int, seed: int) -> tuple[float, float]:
        counts, cells, genes, order = (written(df, "cohort") for df in cohort(spark, n, seed))
        began = time.time()
        r = run_pipeline(counts, cells.select("cell_id"), genes, order, names=cells.where("normal").select("cell_id"), params=Params(subclones=False))
        calls = r.predictions.join(cells, "cell_id").where("not normal").selectExpr("avg(cast(class = 'tumor' as int))").first()[0]
        return time.time() - began, calls

    once(500, 0)  # code is compiled once
    for n in a.cells:
        took = [once(n, 100 + k) for k in range(a.replicates)]
        seconds = [t for t, _ in took]
        print(json.dumps({"cells": n, "replicates": a.replicates, "mean_s": round(statistics.mean(seconds), 2), "sd_s": round(statistics.stdev(seconds), 2) if len(seconds) > 1 else None, "tumor_recall": [round(c, 4) for _, c in took]}), flush=True)


if __name__ == "__main__":
    main()
