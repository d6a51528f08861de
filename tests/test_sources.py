"""Readers: the same matrix in several forms, and validation."""

import gzip
import json

import numpy as np
import pytest

from ploidia.plans.pipeline import npz_of, write_run  # noqa: F401
from ploidia.sources import discover, text, validate
from ploidia.sources.counts import load_counts, resolve_bundle


@pytest.fixture
def files(tmp_path):
    rng = np.random.default_rng(0)
    x = rng.poisson(0.5, (20, 30))
    entries = [(i + 1, j + 1, int(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    head = "%%MatrixMarket matrix coordinate integer general\n% comment\n"
    (tmp_path / "counts.mtx").write_text(head + f"20 30 {len(entries)}\n" + "".join(f"{i} {j} {v}\n" for i, j, v in entries))
    (tmp_path / "obs.csv").write_text("barcode,kind\n" + "".join(f"{i:03d},k{i % 2}\n" for i in range(20)))
    (tmp_path / "var.csv").write_text("symbol\n" + "".join(f"g{j}\n" for j in range(30)))
    d = tmp_path / "outs" / "filtered_feature_bc_matrix"
    d.mkdir(parents=True)
    with gzip.open(d / "matrix.mtx.gz", "wt") as f:
        f.write(head + f"31 20 {len(entries) + 1}\n31 1 7\n" + "".join(f"{j} {i} {v}\n" for i, j, v in entries))
    with gzip.open(d / "barcodes.tsv.gz", "wt") as f:
        f.writelines(f"{i:03d}\n" for i in range(20))
    with gzip.open(d / "features.tsv.gz", "wt") as f:
        f.writelines([*(f"id{j}\tg{j}\tGene Expression\n" for j in range(30)), "ab\tantibody\tAntibody Capture\n"])
    return tmp_path, {(f"{i - 1:03d}", f"g{j - 1}", float(v)) for i, j, v in entries}


def rows(m):
    return {tuple(r) for r in m.counts.select("cell_id", "gene", "value").collect()}


def test_forms_agree(spark, files):
    path, want = files
    trio = load_counts(spark, counts=f"{path}/counts.mtx", obs=f"{path}/obs.csv", var=f"{path}/var.csv")
    tenx = load_counts(spark, cellranger_dir=f"{path}/outs/filtered_feature_bc_matrix")
    assert rows(trio) == want and rows(tenx) == want
    assert [r.cell_ix for r in trio.cells.orderBy("cell_id").collect()] == list(range(20))
    assert trio.cells.where("kind = 'k1'").count() == 10


def test_repeated_coordinates_sum(spark, tmp_path):
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n2 2 3\n1 1 2\n1 1 3\n2 2 1\n")
    assert sorted(tuple(r) for r in text.matrix_market(spark, f"{tmp_path}/m.mtx").collect()) == [(0, 0, 5.0), (1, 1, 1.0)]


def test_exactly_one_form(spark, files):
    path, _ = files
    for how in ({}, {"anndata": "x", "bundle": "y"}, {"counts": "x"}, {"bundle": "x", "raw_count_check": "shout"}):
        with pytest.raises(ValueError):
            load_counts(spark, **how)
    (path / "short.csv").write_text("symbol\ng0\n")
    with pytest.raises(ValueError, match="rows"):
        load_counts(spark, counts=f"{path}/counts.mtx", obs=f"{path}/obs.csv", var=f"{path}/short.csv")


def test_discovery(files):
    path, _ = files
    found = discover.find_inputs(str(path))
    assert found["form"] == "cellranger_dir" and "--cellranger-dir" in found["command"]
    (path / "outs" / "filtered_feature_bc_matrix" / "features.tsv.gz").unlink()
    assert discover.find_inputs(str(path))["form"] == "trio"
    (path / "cell_feature_matrix.zarr.zip").touch()
    (path / "cell_feature_matrix.zarr").mkdir()
    assert resolve_bundle(str(path)).endswith(".zip") and discover.find_inputs(str(path))["form"] == "bundle"
    with pytest.raises(ValueError):
        resolve_bundle(str(path / "outs"))


def test_optional_modules_are_named(spark, tmp_path):
    pytest.importorskip  # noqa: B018
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="h5py"):
            load_counts(spark, cellranger_h5=str(tmp_path / "x.h5"))


@pytest.mark.parametrize(
    ("values", "reason"),
    [([1, 2, 3], None), ([-1, 0.5], "negative"), ([float("nan"), 1], "non_finite"), ([float("inf"), 1.5], "non_finite"), ([1.5, 2], "fractional"), ([1.0000001, 2], None), ([], None)],
)
def test_raw_count_reason(spark, values, reason):
    d = spark.createDataFrame([("c", f"g{i}", float(v)) for i, v in enumerate(values)], "cell_id string, gene string, value double")
    assert validate.raw_count_reason(d) == validate.REASONS.get(reason)


def test_uniform_libraries(spark):
    d = spark.createDataFrame([(f"c{i}", g, v) for i in range(12) for g, v in (("a", 4000.0 + i), ("b", 6000.0))], "cell_id string, gene string, value double")
    assert validate.raw_count_reason(d) == validate.REASONS["uniform"]
    with pytest.raises(ValueError):
        validate.validate_raw_counts(d, "raise")
    with pytest.warns(UserWarning):
        validate.validate_raw_counts(d, "warn")
    validate.validate_raw_counts(d, "raise", has_counts_layer=True)


def test_gene_order_and_lists(spark, tmp_path):
    (tmp_path / "genes.tsv").write_text("gene_symbol\tchr\tstart\tend\nb\tchr2\t5\t9\na\tchr10\t1\t2\nz\tscaffold_1\t1\t2\nc\tchr2\t1\t3\n")
    got = [(r.gene_symbol, r.chr) for r in text.gene_order(spark, f"{tmp_path}/genes.tsv").collect()]
    assert got == [("c", "chr2"), ("b", "chr2"), ("a", "chr10"), ("z", None)]
    (tmp_path / "list.txt").write_text("# note\n\n A \nB\nA\n")
    assert sorted(r[0] for r in text.barcode_list(spark, f"{tmp_path}/list.txt").collect()) == ["A", "B"]
    assert text.cycle_genes(spark).count() == 100


def test_signatures(tmp_path):
    library, labels = text.signature_library()
    assert list(library)[0] == "T_cell" and "Fibroblast" not in labels
    (tmp_path / "s.json").write_text(json.dumps({"_meta": {"non_malignant_labels": ["x"]}, "y": ["g"]}))
    with pytest.raises(ValueError, match="without a signature"):
        text.signature_library(str(tmp_path / "s.json"))
    with pytest.raises(ValueError, match="empty"):
        text.checked_signatures({})


def test_gtf(spark, tmp_path):
    line = lambda *f: "\t".join(f) + "\n"
    a = 'gene_id "i"; gene_name "A";'
    (tmp_path / "x.gtf").write_text("#!head\n" + line("chr2", "s", "gene", "10", "20", ".", "+", ".", a) + line("chr1", "s", "gene", "5", "90", ".", "+", ".", a) + line("chr1", "s", "exon", "1", "999", ".", "+", ".", a) + line("chrM", "s", "gene", "1", "9", ".", "+", ".", a.replace("A", "M")) + "bad\n")
    assert [tuple(r) for r in text.read_gtf(spark, f"{tmp_path}/x.gtf").collect()] == [("A", "chr1", 5, 90)]


def test_archives_and_bytes(spark, tmp_path):
    import io

    from ploidia.session import exists, put_bytes

    put_bytes(spark, f"file://{tmp_path}/deep/x.bin", bytes(range(256)))
    assert (tmp_path / "deep" / "x.bin").read_bytes() == bytes(range(256)) and exists(spark, f"{tmp_path}/deep/x.bin") and not exists(spark, f"{tmp_path}/y")
    t = spark.createDataFrame([("b", [1.0, 2.0]), ("001", [3.0, -1.5])], "cell_id string, cn array<double>")
    held = np.load(io.BytesIO(npz_of(t, sd_amplifier=0.5)))
    assert held["cell_barcodes"].tolist() == ["001", "b"] and held["cn"].tolist() == [[3.0, -1.5], [1.0, 2.0]] and held["sd_amplifier"] == 0.5
    assert np.load(io.BytesIO(npz_of(t.limit(0))))["cn"].shape == (0, 0)
