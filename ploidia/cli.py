"""Command line: run, find-inputs, build-genes, panel."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from . import __version__
from .operators import outputs
from .params import Params
from .plans.pipeline import run_pipeline, write_run
from .session import session
from .sources.counts import load_counts
from .sources.discover import find_inputs
from .sources.text import barcode_list, checked_signatures, cycle_genes, gene_order, read_gtf, signature_library


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("ploidia")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    for name in ("anndata", "counts", "obs", "var", "cellranger-dir", "cellranger-h5", "bundle", "signatures", "cycle-genes"):
        run.add_argument(f"--{name}")
    run.add_argument("--norm-cells", "--norm-cell-names")
    run.add_argument("--gene-order", required=True)
    run.add_argument("--out-dir", required=True)
    run.add_argument("--sample", default="sample")
    run.add_argument("--raw-count-check", default="warn", choices=["warn", "raise", "ignore"])
    run.add_argument("--centered", "--centered-chr-matrix", action="store_true")
    run.add_argument("--denoised", "--denoise-outputs", action="store_true")
    run.add_argument("--non-malignant-labels", help="labels of the library that may name reference cells, with commas between; all by default")
    run.add_argument("--drop-prefix", action="append", help="leave out genes whose name begins so, in place of the usual ones")
    run.add_argument("--drop-chrom", action="append", help="leave out genes of this chromosome, in place of the usual ones")
    run.add_argument("--keep-ig-loci", action="store_true")
    run.add_argument("--keep-cycle-genes", action="store_true")
    for name, value in vars(Params()).items():
        if isinstance(value, bool):
            run.add_argument(f"--no-{name.replace('_', '-')}", dest=name, action="store_false")
        elif isinstance(value, (int, float)):
            run.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    find = sub.add_parser("find-inputs")
    find.add_argument("folder")
    find.add_argument("--sample")
    find.add_argument("--out-dir")
    build = sub.add_parser("build-genes")
    build.add_argument("gtf")
    build.add_argument("out")
    panel = sub.add_parser("panel")
    panel.add_argument("run_dir")
    panel.add_argument("out")
    panel.add_argument("--sd-amplifier", type=float, default=Params.sd_amplifier)
    panel.add_argument("--ref-score-quantile", type=float, default=Params.ref_score_quantile)
    panel.add_argument("--n-ref", type=int, default=Params.heatmap_n_ref)
    panel.add_argument("--max-obs", type=int, default=Params.heatmap_max_obs)
    panel.add_argument("--scale", choices=["log", "linear"], default="log")
    panel.add_argument("--vlim", type=float, default=Params.heatmap_vlim)
    panel.add_argument("--show-low-complexity", action="store_true")
    panel.add_argument("--seed", type=int, default=0)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "find-inputs":
        print(json.dumps(find_inputs(a.folder, a.sample, a.out_dir), indent=1))
        return
    spark = session()
    if a.command == "build-genes":
        read_gtf(spark, a.gtf).coalesce(1).write.mode("overwrite").csv(a.out, sep="\t", header=True)
        return
    if a.command == "panel":
        cn = spark.read.parquet(f"{a.run_dir}/cn_per_segment.parquet").selectExpr("cell_id", "posexplode(cn) as (segment_id, value)")
        calls = spark.read.parquet(f"{a.run_dir}/prediction.parquet").withColumnRenamed("barcode", "cell_id")
        signal = outputs.reference_relative_signal(cn, calls, spark.read.parquet(f"{a.run_dir}/segments.parquet"), a.sd_amplifier, a.ref_score_quantile)
        rows = outputs.panels(signal, calls, n_ref=a.n_ref, max_obs=a.max_obs, quantile=a.ref_score_quantile, show_low_complexity=a.show_low_complexity, seed=a.seed)
        clipped = F.transform("values", lambda x: F.greatest(F.lit(-a.vlim), F.least(F.lit(a.vlim), x)))
        rows.withColumn("values", F.transform(clipped, lambda x: F.exp(x)) if a.scale == "linear" else clipped).write.mode("overwrite").parquet(a.out)
        return
    forms = ("anndata", "counts", "obs", "var", "cellranger_dir", "cellranger_h5", "bundle")
    m = load_counts(spark, raw_count_check=a.raw_count_check, **{f: getattr(a, f) for f in forms})
    params = Params(**{k: getattr(a, k) for k, v in vars(Params()).items() if hasattr(a, k)})
    library, labels = signature_library(a.signatures)
    if a.non_malignant_labels:
        library, labels = checked_signatures(library, [x.strip() for x in a.non_malignant_labels.split(",") if x.strip()])
    rules = {k: tuple(v) for k, v in (("drop_prefixes", a.drop_prefix), ("drop_chroms", a.drop_chrom)) if v}
    if a.keep_ig_loci:
        rules["ig_loci"] = {}
    names = barcode_list(spark, a.norm_cells) if a.norm_cells else None
    r = run_pipeline(m.counts, m.cells, m.genes, gene_order(spark, a.gene_order), cycle=None if a.keep_cycle_genes else cycle_genes(spark, a.cycle_genes), names=names, signatures=library, labels=labels, params=params, rules=rules)
    write_run(r, a.out_dir, a.sample, a.centered, a.denoised, a.sd_amplifier)


if __name__ == "__main__":
    main()
