"""The command line, end to end on files."""

import json

import numpy as np
import pytest

from ploidia import cli


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(7)
    genes = 360
    x = rng.poisson(3, (110, genes))
    x[60:, 120:240] = np.floor(x[60:, 120:240] * 2.5)
    entries = [(i + 1, j + 1, int(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    (d / "counts.mtx").write_text(f"%%MatrixMarket matrix coordinate integer general\n110 {genes} {len(entries)}\n" + "".join(f"{i} {j} {v}\n" for i, j, v in entries))
    (d / "obs.csv").write_text("barcode\n" + "".join(f"{i:03d}\n" for i in range(110)))
    names = [("MT-" if j == 5 else "XX-" if j == 7 else "G") + str(j) for j in range(genes)]
    (d / "var.csv").write_text("symbol\n" + "".join(f"{n}\n" for n in names))
    (d / "genes.tsv").write_text("gene_symbol\tchr\tstart\tend\n" + "".join(f"{n}\tchr{1 + j // 120}\t{100 * j}\t{100 * j + 50}\n" for j, n in enumerate(names)))
    (d / "normal.txt").write_text("# normal cells\n" + "".join(f"{i:03d}\n" for i in range(60)))
    return d


def test_run_and_panel(spark, folder):
    out = folder / "out"
    files = [f"--{k}={folder}/{f}" for k, f in (("counts", "counts.mtx"), ("obs", "obs.csv"), ("var", "var.csv"), ("gene-order", "genes.tsv"), ("norm-cell-names", "normal.txt"))]
    cli.main(["run", *files, f"--out-dir={out}", "--min-genes=50", "--min-seg-genes=20", "--denoise-outputs", "--centered-chr-matrix", "--no-subclones", "--drop-prefix=XX-"])
    qc = json.loads((out / "qc.json").read_text())
    assert qc["n_cells"] == 110 and qc["n_genes"] == 359 and qc["baseline_method"] == "supervised" and qc["n_normal_reference"] == 60
    calls = {r.barcode: r for r in spark.read.parquet(f"{out}/prediction.parquet").collect()}
    assert sum(calls[f"{i:03d}"]["class"] == "tumor" for i in range(60, 110)) >= 48 and all(r.subclone == "" for r in calls.values())
    held = np.load(out / "cn_per_segment.npz")
    assert held["cn"].shape == (110, qc["n_segments"]) and held["cell_barcodes"][0] == "000"
    assert np.load(out / "cn_per_segment_denoised.npz")["sd_amplifier"] == 1.0
    cli.main(["panel", str(out), str(folder / "panel"), "--n-ref=10", "--vlim=0.1", "--scale=linear"])
    rows = spark.read.parquet(f"{folder}/panel").collect()
    by = {}
    for r in rows:
        by.setdefault(r.panel, []).append(r.row)
        assert all(np.exp(-0.1) - 1e-9 <= v <= np.exp(0.1) + 1e-9 for v in r["values"])
    assert len(by["references"]) == 10 and sorted(by["observations"]) == list(range(len(by["observations"])))


def test_labels_that_the_library_lacks(folder, spark):
    files = [f"--{k}={folder}/{f}" for k, f in (("counts", "counts.mtx"), ("obs", "obs.csv"), ("var", "var.csv"), ("gene-order", "genes.tsv"))]
    with pytest.raises(ValueError, match="no_such_label"):
        cli.main(["run", *files, f"--out-dir={folder}/never", "--min-genes=50", "--non-malignant-labels=no_such_label"])
