"""Finds an input below a folder and says how to run it. Local listing only, no Spark job."""

from __future__ import annotations

import gzip
from pathlib import Path

from .counts import BUNDLES

MTX_FOLDERS = ["outs/filtered_feature_bc_matrix", "filtered_feature_bc_matrix", "outs/raw_feature_bc_matrix", "raw_feature_bc_matrix"]
H5_FILES = [f"{d}.h5" for d in MTX_FOLDERS] + ["outs/cell_feature_matrix.h5", "cell_feature_matrix.h5"]


def probe_10x(folder: Path) -> int | None:
    """Number of barcodes, or None if a file is missing."""
    has = lambda *n: next((folder / x for x in n if (folder / x).exists()), None)
    barcodes = has("barcodes.tsv.gz", "barcodes.tsv")
    if not (barcodes and has("matrix.mtx.gz", "matrix.mtx") and has("features.tsv.gz", "features.tsv", "genes.tsv.gz", "genes.tsv")):
        return None
    with gzip.open(barcodes, "rt") if barcodes.suffix == ".gz" else barcodes.open() as f:
        return sum(1 for _ in f)


def find_inputs(root: str, sample: str | None = None, out_dir: str | None = None) -> dict:
    """{"form", "options", "command", "warnings"}; 10x folder before 10x H5, bundle, h5ad and trio; form None if none."""
    r = Path(root)
    out = out_dir or f"results/{sample or r.name}"
    notes = [f"{p.name}: .cloupe files can't be read; export the matrix" for p in sorted(r.glob("**/*.cloupe"))]
    form, options = None, {}
    for d in MTX_FOLDERS:
        if (r / d).is_dir() and probe_10x(r / d) is not None:
            form, options = "cellranger_dir", {"cellranger_dir": str(r / d)}
            break
    else:
        if found := next((r / f for f in H5_FILES if (r / f).exists()), None):
            form, options = "cellranger_h5", {"cellranger_h5": str(found)}
        elif found := next((r / b for b in BUNDLES if (r / b).exists()), None):
            form, options = "bundle", {"bundle": str(found)}
        elif found := next(iter(sorted(r.glob("**/*.h5ad"))), None):
            form, options = "anndata", {"anndata": str(found)}
        else:
            for d in (r / "normalization", r):
                if all((d / f).exists() for f in ("counts.mtx", "obs.csv", "var.csv")):
                    form, options = "trio", {"counts": str(d / "counts.mtx"), "obs": str(d / "obs.csv"), "var": str(d / "var.csv")}
                    break
    flags = " ".join(f"--{k.replace('_', '-')} {v}" for k, v in options.items())
    return {"form": form, "options": options, "command": f"python -m ploidia.cli run {flags} --out-dir {out}" if form else None, "warnings": notes}
