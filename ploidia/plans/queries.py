"""One query an operator, over whole tables, and its SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import genome
from ..operators import evaluate, m1, m2, m3, m4, outputs
from ..params import Params
from ..session import scratch, written
from ..sources import text, validate
from ..sources.counts import BUNDLES, load_counts, read_10x_mtx, read_mtx_trio, resolve_bundle
from ..sources.discover import find_inputs
from . import driver_tables as t
from . import sql
from .pipeline import run_pipeline

QUERIES: dict = {}
SQL: dict[str, str] = {}

# ---- SQL that several queries build on: single-cell view, and embeddings ----------------------------------------------

BASE = """
WITH cells AS (SELECT s_suppkey AS cell_id, n_regionkey::INT AS region, n_regionkey <= 2 AS is_ref FROM supplier JOIN nation ON s_nationkey = n_nationkey),
counts AS (SELECT l_suppkey AS cell_id, p_brand || '-' || p_size AS gene, sum(l_quantity::DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
genes AS (SELECT DISTINCT p_brand || '-' || p_size AS gene, p_brand AS chr, regexp_extract(p_brand, '(\\d+)$', 1)::INT AS chr_rank, p_size::BIGINT * 10 AS "start", p_size::BIGINT * 10 + (p_size * 7) % 23 AS "end" FROM part),
kept AS (SELECT c.*, coalesce(n, 0)::BIGINT AS n_genes FROM cells c LEFT JOIN (SELECT cell_id, count(*) FILTER (value > 0) AS n FROM counts GROUP BY 1) USING (cell_id) WHERE coalesce(n, 0) >= 100),
found AS (SELECT g.*, coalesce(n, 0)::BIGINT AS n_cells FROM genes g LEFT JOIN (SELECT gene, count(*) FILTER (value > 0) AS n FROM counts WHERE cell_id IN (SELECT cell_id FROM kept) GROUP BY 1) USING (gene)
  WHERE coalesce(n, 0) >= 3 AND coalesce(n, 0) / greatest((SELECT count(*) FROM kept), 1) BETWEEN 0.05 AND 1.0),
axis AS (SELECT *, (row_number() OVER (ORDER BY chr_rank, "start") - 1)::INT AS gene_ix FROM found),
vals AS (SELECT cell_id, gene_ix, ln(1 + value * 10000.0 / total) AS value FROM (SELECT cell_id, gene, value, sum(value) OVER (PARTITION BY cell_id) AS total FROM counts WHERE cell_id IN (SELECT cell_id FROM kept) AND gene IN (SELECT gene FROM found)) JOIN axis USING (gene)),
dense AS (SELECT k.cell_id, k.is_ref, a.gene_ix, a.chr, coalesce(v.value, 0.0) AS value FROM kept k CROSS JOIN axis a LEFT JOIN vals v ON v.cell_id = k.cell_id AND v.gene_ix = a.gene_ix),
med AS (SELECT gene_ix, median(value) AS med FROM dense WHERE is_ref GROUP BY 1),
chrs AS (SELECT chr, min(gene_ix) AS base, count(*)::INT AS n, greatest(10, least(100, count(*) // 3 + 1))::INT AS w FROM axis GROUP BY 1),
kern AS (SELECT gene_ix AS i, base + greatest(0, least(n - 1, gene_ix - base + o)) AS j, count(*) / w::DOUBLE AS k FROM (SELECT a.gene_ix, c.*, unnest(generate_series(-(c.w // 2), c.w - c.w // 2 - 1)) AS o FROM axis a JOIN chrs c USING (chr)) GROUP BY gene_ix, j, w),
cent AS (SELECT cell_id, is_ref, gene_ix, chr, value - med AS value FROM dense JOIN med USING (gene_ix)),
smooth AS (SELECT cell_id, is_ref, i AS gene_ix, sum(k * value) AS value FROM cent JOIN kern ON gene_ix = j GROUP BY ALL),
tiles AS (SELECT chr, min(gene_ix) AS start_idx, max(gene_ix) + 1 AS end_idx, count(*)::INT AS n_genes, min("start") AS start_bp, max("end") AS end_bp, (row_number() OVER (ORDER BY min(gene_ix)) - 1)::INT AS segment_id FROM axis GROUP BY chr),
cn AS (SELECT cell_id, is_ref, segment_id, avg(value) AS value FROM smooth JOIN tiles ON gene_ix >= start_idx AND gene_ix < end_idx GROUP BY ALL),
base AS (SELECT segment_id, median(value) AS baseline FROM cn WHERE is_ref GROUP BY 1)
"""

EMB = """
WITH own AS (SELECT vec_id AS cell_id, label < 5 AS is_ref, label::INT AS label FROM embeddings),
cn AS (SELECT vec_id AS cell_id, unnest(range(64))::INT AS segment_id, unnest(embedding)::DOUBLE AS value FROM embeddings),
segs AS (SELECT s::INT AS segment_id, 'chr' || (s // 8 + 1) AS chr, (s // 8)::INT AS chr_rank, (25 + s % 4 * 10)::INT AS n_genes FROM range(64) r(s)),
base AS (SELECT segment_id, median(value) AS baseline FROM cn JOIN own USING (cell_id) WHERE is_ref GROUP BY 1),
rel AS (SELECT cell_id, segment_id, value - baseline AS value, n_genes::DOUBLE AS w FROM cn JOIN base USING (segment_id) JOIN segs USING (segment_id)),
wm AS (SELECT cell_id, min(value) FILTER (acc >= total / 2) AS med FROM (SELECT *, sum(w) OVER (PARTITION BY cell_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY cell_id) AS total FROM rel) GROUP BY 1),
dev AS (SELECT cell_id, segment_id, value - med AS value, w FROM rel JOIN wm USING (cell_id)),
bur AS (SELECT cell_id, sum(w * abs(value)) / sum(w) AS burden FROM dev GROUP BY 1),
tem AS (SELECT segment_id, avg(value / burden) AS t FROM dev JOIN bur USING (cell_id) WHERE burden >= (SELECT quantile_cont(burden, 0.75) FROM bur) GROUP BY 1),
sco AS (SELECT cell_id, sum(w * t * value) / sum(abs(w * t)) AS score FROM dev JOIN tem USING (segment_id) GROUP BY 1),
coh AS (SELECT cell_id, sum(CASE WHEN sign(value) = sign(loc) THEN least(abs(value), abs(loc)) ELSE 0 END) / (sum(abs(value)) + 1e-9) AS coherent FROM (SELECT *, avg(value) OVER (PARTITION BY cell_id, segment_id // 8 ORDER BY segment_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS loc FROM dev) GROUP BY 1),
scored AS (SELECT o.*, score, burden, coherent, o.cell_id % 11 = 0 AS low_complexity FROM own o JOIN sco USING (cell_id) JOIN bur USING (cell_id) JOIN coh USING (cell_id)),
called AS (SELECT *, CASE WHEN score > (SELECT quantile_cont(score, 0.6) FROM scored) AND NOT is_ref THEN 'tumor' ELSE 'normal' END AS class, 0.5 + (cell_id % 50) / 100.0 AS confidence FROM scored),
pred AS (SELECT *, CASE WHEN class = 'tumor' THEN 'subclone_' || (label % 3 + 1) ELSE '' END AS subclone FROM called)
"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def r6(c):
    return F.round(c, 6)


# ---- sources and validation ------------------------------------------------------------------------------------------


@query("src8_gene_order", "SELECT p_name || p_partkey AS gene_symbol, CASE WHEN p_size <= 22 THEN 'chr' || p_size END AS chr, CASE WHEN p_size <= 22 THEN p_size - 1 END::INT AS chr_rank, p_partkey::BIGINT AS \"start\", (p_partkey + 10)::BIGINT AS \"end\" FROM part")
def src8(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "part")
    contig = F.when(F.col("p_size") <= 22, F.concat(F.lit("chr"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("scaffold"), F.col("p_size").cast("string")))
    return text.ordered_genes(p.select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("gene_symbol"), contig.alias("chr"), F.col("p_partkey").cast("long").alias("start"), (F.col("p_partkey") + 10).cast("long").alias("end")))


@query("src9_cycle_genes", "SELECT DISTINCT trim(v) AS symbol FROM (SELECT CASE p_size % 5 WHEN 0 THEN '# ' || p_name WHEN 1 THEN '  ' ELSE ' ' || p_name || ' ' END AS v FROM part) WHERE trim(v) <> '' AND NOT starts_with(trim(v), '#')")
def src9(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("p_size") % 5
    lines = t.table(spark, d, "part").select(F.when(m == 0, F.concat(F.lit("# "), "p_name")).when(m == 1, F.lit("  ")).otherwise(F.concat(F.lit(" "), "p_name", F.lit(" "))).alias("value"))
    return text.symbols_of(lines)


@query("src10_signatures", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{label}', '{g}')" for i, (label, gs) in enumerate(genome.SIGNATURES.items()) for g in dict.fromkeys(gs)) + ") v(label_ix, label, gene)")
def src10(spark: SparkSession, d: str) -> DataFrame:
    return text.signature_table(spark, text.signature_library()[0])


@query("src11_barcodes", "SELECT DISTINCT trim(c_mktsegment || '-' || c_nationkey) AS cell_id FROM customer")
def src11(spark: SparkSession, d: str) -> DataFrame:
    return text.symbols_of(t.table(spark, d, "customer").select(F.concat(F.lit(" "), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string"))).alias("value")), "cell_id")


@query(
    "src12_gtf_genes",
    """WITH g AS (SELECT p_partkey AS ix, p_brand || '_' || p_type AS gene_symbol, 'chr' || (p_size % 22 + 1) AS chr, p_partkey::BIGINT AS "start", p_partkey + p_size * 3 AS "end" FROM part WHERE p_partkey % 7 <> 0)
       SELECT gene_symbol, chr, "start", "end"::BIGINT AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY gene_symbol ORDER BY "end" - "start" DESC, ix) AS rn FROM g) WHERE rn = 1""",
)
def src12(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "part")
    kind = F.when(F.col("p_partkey") % 7 == 0, "exon").otherwise("gene")
    name = F.concat(F.lit('gene_id "x"; gene_name "'), "p_brand", F.lit("_"), "p_type", F.lit('"; level 2;'))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("p_size") % 22 + 1).cast("string")), F.lit("src"), kind, F.col("p_partkey").cast("string"), (F.col("p_partkey") + F.col("p_size") * 3).cast("string"), F.lit("."), F.lit("+"), F.lit("."), name)
    return text.gene_table_from_gtf(p.select(line.alias("value"), F.col("p_partkey").alias("ix")))


def _matrix_files(spark: SparkSession, d: str, transposed: bool) -> str:
    """A folder with the line items as Matrix Market entries, repeated coordinates and all, and its axes. The forms are single files."""
    folder = scratch(spark, "matrix")
    cells = t.cells(spark, d).select("cell_id", F.row_number().over(Window.orderBy("cell_id")).alias("i"))
    genes = t.genes(spark, d).select("gene", F.row_number().over(Window.orderBy("orig_ix")).alias("j"))
    items = t.table(spark, d, "lineitem").join(t.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("cell_id"), F.concat_ws("-", "p_brand", "p_size").alias("gene"), F.col("l_quantity").cast("double").alias("value"))
    entries = items.join(cells, "cell_id").join(genes, "gene").select(F.lit(1).alias("o"), F.concat_ws(" ", *(("j", "i") if transposed else ("i", "j")), "value").alias("value"))
    n, m, k = cells.count(), genes.count(), items.count()
    head = spark.createDataFrame([(0, f"%%MatrixMarket matrix coordinate real general\n% made of line items\n{f'{m} {n}' if transposed else f'{n} {m}'} {k}")], "o int, value string")
    head.unionByName(entries).coalesce(1).sortWithinPartitions("o").select("value").write.option("compression", "gzip" if transposed else "none").text(f"{folder}/{'matrix.mtx.gz' if transposed else 'counts.mtx'}")
    line = lambda df, o, *c: df.coalesce(1).sortWithinPartitions(o).select(F.concat_ws("\t" if transposed else ",", *c).alias("value"))
    if transposed:
        line(cells, "i", "cell_id").write.option("compression", "gzip").text(f"{folder}/barcodes.tsv.gz")
        line(genes, "j", F.concat(F.lit("id"), "j"), "gene", F.when(F.col("j") % 7 == 0, "Antibody Capture").otherwise("Gene Expression")).write.option("compression", "gzip").text(f"{folder}/features.tsv.gz")
    else:
        cells.coalesce(1).sortWithinPartitions("i").select(F.col("cell_id").alias("barcode"), (F.col("i") % 2).alias("kind")).write.option("header", True).csv(f"{folder}/obs.csv")
        genes.coalesce(1).sortWithinPartitions("j").select(F.col("gene").alias("symbol")).write.option("header", True).csv(f"{folder}/var.csv")
    return folder


RAW = BASE + ", gx AS (SELECT gene, row_number() OVER (ORDER BY chr_rank * 1000 + \"start\" // 10) AS j FROM genes)"


@query("src3_mtx_trio", RAW + " SELECT cell_id::VARCHAR AS cell_id, gene, value FROM counts")
def src3(spark: SparkSession, d: str) -> DataFrame:
    folder = _matrix_files(spark, d, False)
    return read_mtx_trio(spark, f"{folder}/counts.mtx", f"{folder}/obs.csv", f"{folder}/var.csv").counts


@query("src4_10x_mtx", RAW + " SELECT cell_id::VARCHAR AS cell_id, gene, value FROM counts JOIN gx USING (gene) WHERE j % 7 <> 0")
def src4(spark: SparkSession, d: str) -> DataFrame:
    return read_10x_mtx(spark, _matrix_files(spark, d, True)).counts


@query("src1_load_counts", RAW + " SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS cell_ix, s_suppkey::VARCHAR AS cell_id, (row_number() OVER (ORDER BY s_suppkey) % 2)::VARCHAR AS kind, coalesce((SELECT sum(value) FROM counts c WHERE c.cell_id = s_suppkey), 0) AS total FROM supplier")
def src1(spark: SparkSession, d: str) -> DataFrame:
    folder = _matrix_files(spark, d, False)
    m = load_counts(spark, counts=f"{folder}/counts.mtx", obs=f"{folder}/obs.csv", var=f"{folder}/var.csv", raw_count_check="raise")
    totals = m.counts.groupBy("cell_id").agg(F.sum("value").alias("total"))
    return m.cells.join(totals, "cell_id", "left").select("cell_ix", "cell_id", "kind", F.coalesce("total", F.lit(0.0)).alias("total"))


FOUND = [("10x folder", "cellranger_dir"), ("10x file", "cellranger_h5"), ("bundle folder", "bundle"), ("bundle file", "bundle"), ("h5ad", "anndata"), ("trio", "trio"), ("nothing", None)]


@query("src13_find_inputs", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if f is None else repr(f)})" for k, f in FOUND) + ') v(had, form)')
def src13(spark: SparkSession, d: str) -> DataFrame:
    """What is found in folders that have ever less: the listing is of local files, so they are made for it."""
    import tempfile
    from pathlib import Path

    gone = ["outs/filtered_feature_bc_matrix", "filtered_feature_bc_matrix.h5", "outs/cell_feature_matrix.zarr", "cell_feature_matrix.zarr.zip", "deep/er/x.h5ad", "normalization"]
    with tempfile.TemporaryDirectory() as top:
        root = Path(top)
        for folder, files in ((gone[0], ["barcodes.tsv", "matrix.mtx", "genes.tsv"]), (gone[5], ["counts.mtx", "obs.csv", "var.csv"])):
            (root / folder).mkdir(parents=True)
            for f in files:
                (root / folder / f).write_text("x\n")
        (root / gone[2]).mkdir()
        (root / "deep/er").mkdir(parents=True)
        for f in (gone[1], gone[3], gone[4]):
            (root / f).touch()
        rows = []
        for (had, _), path in zip(FOUND, [*gone, None], strict=True):
            rows.append((had, find_inputs(top)["form"]))
            if path:
                (root / path).rename(root / f"used-{len(rows)}{'.old' if '.' in path else ''}")
    return spark.createDataFrame(rows, "had string, form string")


@query("src6_bundle_path", "SELECT * FROM (VALUES (0, 'outs/cell_feature_matrix.zarr.zip'), (1, 'cell_feature_matrix.zarr.zip'), (2, 'outs/cell_feature_matrix.zarr'), (3, 'cell_feature_matrix.zarr'), (4, NULL)) v(without, found)")
def src6(spark: SparkSession, d: str) -> DataFrame:
    import tempfile
    from pathlib import Path

    rows = []
    with tempfile.TemporaryDirectory() as top:
        (Path(top) / "outs").mkdir()
        for c in BUNDLES:
            (Path(top) / c).touch()
        for i in range(len(BUNDLES) + 1):
            try:
                rows.append((i, resolve_bundle(top)[len(top) + 1 :]))
            except ValueError:
                rows.append((i, None))
            if i < len(BUNDLES):
                (Path(top) / BUNDLES[i]).unlink()
    return spark.createDataFrame(rows, "without int, found string")


@query("val3_validate", "SELECT * FROM (VALUES ('fractional', 'raise', 'error'), ('fractional', 'warn', 'warning'), ('fractional', 'ignore', 'nothing'), ('raw', 'raise', 'nothing'), ('raw', 'warn', 'nothing'), ('raw', 'ignore', 'nothing')) v(matrix, action, came)")
def val3(spark: SparkSession, d: str) -> DataFrame:
    import warnings

    raw = written(t.counts(spark, d), "counts")
    rows = []
    for name, m in (("fractional", raw.withColumn("value", F.col("value") + 0.5)), ("raw", raw)):
        for action in ("raise", "warn", "ignore"):
            with warnings.catch_warnings(record=True) as told:
                warnings.simplefilter("always")
                try:
                    validate.validate_raw_counts(m, action)
                    rows.append((name, action, "warning" if any("raw counts" in str(w.message) for w in told) else "nothing"))
                except ValueError:
                    rows.append((name, action, "error"))
    return spark.createDataFrame(rows, "matrix string, action string, came string")


LIB = """, lib AS (SELECT count(*) AS n, stddev_pop(tot) / avg(tot) AS cv, median(tot) AS med FROM (SELECT cell_id, sum(value) AS tot FROM counts GROUP BY 1 HAVING sum(value) > 0))
SELECT CASE WHEN (SELECT bool_or(value < 0) FROM counts) THEN 'negative' WHEN (SELECT bool_or(isnan(value) OR isinf(value)) FROM counts) THEN 'non_finite' WHEN (SELECT bool_or(abs(value - round_even(value, 0)) > 1e-6) FROM counts) THEN 'fractional'
  WHEN n >= 10 AND cv < 0.01 AND (abs(med - 10000) <= 200 OR abs(med - 1000000) <= 20000) THEN 'uniform' END AS reason FROM lib"""


@query("val1_raw_count_reason", BASE + LIB)
def val1(spark: SparkSession, d: str) -> DataFrame:
    return validate.raw_count_reason_table(t.counts(spark, d))


@query("val2_looks_raw", "SELECT count(*) = 0 AS is_raw FROM (SELECT sum(l_quantity * (1 - l_discount)) AS value FROM lineitem GROUP BY l_suppkey, l_partkey) WHERE abs(value - round(value)) > 1e-6")
def val2(spark: SparkSession, d: str) -> DataFrame:
    net = t.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell_id"), F.col("l_partkey").alias("gene")).agg(F.sum((F.col("l_quantity") * (1 - F.col("l_discount"))).cast("double")).alias("value"))
    return validate.raw_count_reason_table(net).select(F.col("reason").isNull().alias("is_raw"))


@query("val4_is_normalized", "SELECT min(value) < 0 AS is_normalized FROM (SELECT unnest(embedding) AS value FROM embeddings)")
def val4(spark: SparkSession, d: str) -> DataFrame:
    return t.matrix(spark, d)[0].agg((F.min("value") < 0).alias("is_normalized"))


# ---- cells and genes -------------------------------------------------------------------------------------------------


@query("m1a_cell_filter", BASE + "SELECT cell_id, n_genes FROM kept")
def m1a(spark: SparkSession, d: str) -> DataFrame:
    return m1.cell_filter(t.counts(spark, d), t.cells(spark, d), 100).select("cell_id", "n_genes")


@query("m1b_gene_filter", BASE + "SELECT gene, n_cells FROM found")
def m1b(spark: SparkSession, d: str) -> DataFrame:
    c = t.counts(spark, d)
    return m1.gene_filter(c, m1.cell_filter(c, t.cells(spark, d), 100), t.genes(spark, d).select("gene")).select("gene", "n_cells")


@query("m1c_qc_columns", BASE + "SELECT 'cell' AS axis, count(*) AS n, sum(n_genes)::BIGINT AS detected FROM kept UNION ALL SELECT 'gene', count(*), sum(n_cells)::BIGINT FROM found")
def m1c(spark: SparkSession, d: str) -> DataFrame:
    c = t.counts(spark, d)
    kept = m1.cell_filter(c, t.cells(spark, d), 100)
    found = m1.gene_filter(c, kept, t.genes(spark, d).select("gene"))
    line = lambda df, name, col: df.agg(F.count("*").alias("n"), F.sum(col).alias("detected")).select(F.lit(name).alias("axis"), "n", "detected")
    return line(kept, "cell", "n_genes").unionByName(line(found, "gene", "n_cells"))


@query("m1d_first_names", "SELECT p_name AS gene, min(p_partkey) AS orig_ix FROM part GROUP BY 1")
def m1d(spark: SparkSession, d: str) -> DataFrame:
    return m1.first_names(t.table(spark, d, "part").select(F.col("p_name").alias("gene"), F.col("p_partkey").alias("orig_ix")))


@query("m1e_log1p_cp10k", BASE + "SELECT cell_id, gene, round(ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM counts")
def m1e(spark: SparkSession, d: str) -> DataFrame:
    return m1.normalize_log1p(t.counts(spark, d)).select("cell_id", "gene", r6("value").alias("value"))


@query("m1f_gene_mask", "SELECT p_partkey AS orig_ix, p_name AS gene, p_brand AS chr FROM part WHERE p_size <= 45 AND NOT starts_with(p_name, 'a') AND NOT starts_with(p_name, 'be') AND NOT (starts_with(p_name, 'c') AND p_brand = 'Brand#11') AND p_type NOT IN (SELECT p_type FROM part WHERE p_size = 1 AND p_partkey % 50 = 0) AND p_brand <> 'Brand#55'")
def m1f(spark: SparkSession, d: str) -> DataFrame:
    p = t.table(spark, d, "part")
    chrom = F.when(F.col("p_size") <= 45, F.col("p_brand"))
    named = p.select(F.col("p_partkey").alias("orig_ix"), F.col("p_name").alias("gene"), chrom.alias("chr"), "p_type").where(genome.placeable(F.col("p_name"), F.col("chr"), ("a", "be"), ("Brand#55",), {"c": "Brand#11"}))
    return named.join(p.where("p_size = 1 and p_partkey % 50 = 0").select("p_type").distinct(), "p_type", "left_anti").select("orig_ix", "gene", "chr")


@query("m1g_genome_order", BASE + 'SELECT gene, chr, chr_rank, "start", "end", gene_ix FROM axis')
def m1g(spark: SparkSession, d: str) -> DataFrame:
    return t.filtered(spark, d)[2].select("gene", "chr", "chr_rank", "start", "end", "gene_ix")


@query("m1h_values", BASE + "SELECT cell_id, gene_ix, round(value, 6) AS value FROM vals")
def m1h(spark: SparkSession, d: str) -> DataFrame:
    return t.filtered(spark, d)[0].select("cell_id", "gene_ix", r6("value").alias("value"))


@query("m1i_detected", BASE + "SELECT k.cell_id, count(v.gene_ix) AS detected FROM kept k LEFT JOIN (SELECT * FROM vals WHERE value <> 0) v USING (cell_id) GROUP BY 1")
def m1i(spark: SparkSession, d: str) -> DataFrame:
    values, kept, _ = t.filtered(spark, d)
    return m1.detected_genes(values, kept)


# ---- reference pool --------------------------------------------------------------------------------------------------


@query("m2a_supervised_pool", "SELECT s_suppkey AS cell_id, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2) AS is_ref FROM supplier")
def m2a(spark: SparkSession, d: str) -> DataFrame:
    own = t.cells(spark, d)
    return m2.supervised_pool(own.select("cell_id"), own.where("is_ref").select("cell_id"))[0]


@query("m2a_supervised_facts", "SELECT count(*) AS n_supplied, count(s_suppkey) AS n_matched, count(*) FILTER (s_suppkey IS NULL) AS n_unmatched FROM (SELECT DISTINCT c_custkey FROM customer WHERE c_nationkey % 3 = 0) LEFT JOIN supplier ON s_suppkey = c_custkey")
def m2a_facts(spark: SparkSession, d: str) -> DataFrame:
    supplied = t.table(spark, d, "customer").where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("cell_id"))
    return m2.supervised_pool(t.cells(spark, d).select("cell_id"), supplied)[1]


UCELL = BASE + """, sig AS (SELECT gene_ix, chr_rank % 4 AS label_ix, 'L' || (chr_rank % 4) AS label FROM axis WHERE "start" % 70 = 0),
rk AS (SELECT cell_id, gene_ix, r + (ties - 1) / 2.0 AS rank FROM (SELECT cell_id, gene_ix, rank() OVER (PARTITION BY cell_id ORDER BY value DESC) AS r, count(*) OVER (PARTITION BY cell_id, value) AS ties FROM vals WHERE value > 0)),
hit AS (SELECT cell_id, label_ix, count(*) AS hits, sum(rank) AS s FROM rk JOIN sig USING (gene_ix) WHERE rank <= 300 GROUP BY ALL),
uc AS (SELECT k.cell_id, z.label_ix::INT AS label_ix, z.label, 1 - (coalesce(s, 0) + (n - coalesce(hits, 0)) * 301 - n * (n + 1) / 2) / (n * 300 - n * (n + 1) / 2) AS score FROM kept k CROSS JOIN (SELECT label_ix, label, count(*) AS n FROM sig GROUP BY ALL) z LEFT JOIN hit h ON h.cell_id = k.cell_id AND h.label_ix = z.label_ix)
"""


def _ucell(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    sig = axis.where(F.col("start") % 70 == 0).select("gene_ix", (F.col("chr_rank") % 4).alias("label_ix"), F.concat(F.lit("L"), F.col("chr_rank") % 4).alias("label"))
    return m2.ucell_scores(values, kept, sig, 300)


@query("m2b_ucell", UCELL + "SELECT cell_id, label_ix, label, round(score, 6) AS score FROM uc")
def m2b_ucell(spark: SparkSession, d: str) -> DataFrame:
    return _ucell(spark, d).select("cell_id", F.col("label_ix").cast("int").alias("label_ix"), "label", r6("score").alias("score"))


@query("m2b_signature_pool", UCELL + "SELECT cell_id, label AS top_label, round(score, 6) AS top_score, score >= 0.3 AND label IN ('L0', 'L2') AS is_ref FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, label_ix) AS rn FROM uc) WHERE rn = 1")
def m2b(spark: SparkSession, d: str) -> DataFrame:
    return m2.signature_pool(_ucell(spark, d), ["L0", "L2"]).select("cell_id", "top_label", r6("top_score").alias("top_score"), "is_ref")


@query("m2c_cluster_variance", BASE + "SELECT region AS cluster, n, round(CASE WHEN n < 2 THEN 'inf'::DOUBLE ELSE v END, 6) AS variance FROM (SELECT region, max(n) AS n, avg(v) AS v FROM (SELECT region, gene_ix, count(*) AS n, sum(d.value * d.value) / count(*) - (sum(d.value) / count(*)) ** 2 AS v FROM dense d JOIN cells USING (cell_id) GROUP BY ALL) GROUP BY 1)")
def m2c(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m2.cluster_variance(values, kept.select("cell_id", F.col("region").alias("cluster")), axis.count()).select("cluster", "n", r6("variance").alias("variance"))


@query("m2c_variance_pool")
def m2c_pool(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m2.variance_pool(values, kept, axis.count(), t.PARAMS)[0]


@query("m2d_cell_variance", BASE + "SELECT cell_id, round(sum(value * value) / count(*) - (sum(value) / count(*)) ** 2, 6) AS variance FROM dense GROUP BY 1")
def m2d(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m2.cell_variance(values, kept, axis.count()).select("cell_id", r6("variance").alias("variance"))


@query("m2d_mixture_pool", BASE + ", cv AS (SELECT cell_id, sum(value * value) / count(*) - (sum(value) / count(*)) ** 2 AS variance FROM dense GROUP BY 1)" + sql.mixture("SELECT variance AS x FROM cv") + f"SELECT cell_id, {sql.posterior('variance')} <= 0.5 AS is_ref FROM cv CROSS JOIN mix")
def m2d_pool(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m2.mixture_pool(values, kept, axis.count())[0]


@query("m2e_pick_pool")
def m2e(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m2.pick_pool(values, kept.drop("is_ref"), axis, params=t.PARAMS)[0].select("cell_id", "is_ref")


@query("m2e_supervised_tier", BASE + "SELECT cell_id, is_ref FROM kept")
def m2e_supervised(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m2.pick_pool(values, kept.drop("is_ref"), axis, names=kept.where("is_ref").select("cell_id"), params=t.PARAMS)[0].select("cell_id", "is_ref")


@query("m2e_signature_tier", UCELL + "SELECT cell_id, score >= 0.01 AND label IN ('L0', 'L2') AS is_ref FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY score DESC, label_ix) AS rn FROM uc) WHERE rn = 1")
def m2e_signature(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    genes = axis.where(F.col("start") % 70 == 0).select("gene", "chr_rank").collect()  # of the gene axis
    library = {f"L{i}": sorted(g.gene for g in genes if g.chr_rank % 4 == i) for i in range(4)}
    params = Params(ucell_max_rank=300, normal_score_threshold=0.01, min_normal_cells=1)
    return m2.pick_pool(values, kept.drop("is_ref"), axis, signatures=library, labels=["L0", "L2"], params=params)[0].select("cell_id", "is_ref")


# ---- centre, smooth, segment -----------------------------------------------------------------------------------------


@query("m3a_gene_median", BASE + "SELECT gene_ix, round(med, 6) AS med FROM med")
def m3a(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m3.gene_medians(values, kept, axis).select("gene_ix", r6("med").alias("med"))


def _smooth(spark: SparkSession, d: str):
    values, kept, axis = t.filtered(spark, d)
    med = m3.gene_medians(values, kept, axis)
    return m3.centered(values, kept, axis, med), kept, axis


@query("m3b_centered", BASE + "SELECT cell_id, gene_ix, round(value, 6) AS value FROM cent")
def m3b(spark: SparkSession, d: str) -> DataFrame:
    return _smooth(spark, d)[0].select("cell_id", "gene_ix", r6("value").alias("value"))


@query("m3c_smooth", BASE + "SELECT cell_id, gene_ix, round(value, 6) AS value FROM smooth")
def m3c(spark: SparkSession, d: str) -> DataFrame:
    signal, _, axis = _smooth(spark, d)
    return m3.smoothed(signal, axis, ["cell_id"]).select("cell_id", "gene_ix", r6("value").alias("value"))


@query("m3d_block_rows", BASE + "SELECT greatest(1, floor(1.5e9 / (4 * greatest(count(*), 1))))::BIGINT AS rows FROM axis")
def m3d(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(m3.block_rows(t.filtered(spark, d)[2].count()),)], "rows bigint")


@query("m3e_pooled", BASE + "SELECT gene_ix, round(avg(value), 6) AS value FROM smooth WHERE NOT is_ref GROUP BY 1")
def m3e(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    return m3.pooled_signal(values, kept, axis, m3.gene_medians(values, kept, axis)).select("gene_ix", r6("value").alias("value"))


POOLED = BASE + ", pooled AS (SELECT gene_ix, chr, avg(s.value) AS value FROM smooth s JOIN axis USING (gene_ix) WHERE NOT is_ref GROUP BY ALL)"
NUMBERED = """, segs AS (SELECT (row_number() OVER (ORDER BY start_idx) - 1)::INT AS segment_id, chr, start_idx::INT AS start_idx, end_idx::INT AS end_idx, (end_idx - start_idx)::INT AS n_genes,
  (SELECT avg(value) FROM pooled p WHERE p.gene_ix >= brk.start_idx AND p.gene_ix < brk.end_idx) AS tumor_mean, (SELECT min("start") FROM axis a WHERE a.gene_ix >= brk.start_idx AND a.gene_ix < brk.end_idx) AS start_bp, (SELECT max("end") FROM axis a WHERE a.gene_ix >= brk.start_idx AND a.gene_ix < brk.end_idx)::BIGINT AS end_bp FROM brk)
"""


@query("m3f_segments", POOLED + sql.segments(5) + NUMBERED + "SELECT segment_id, chr, start_idx, end_idx, n_genes, round(tumor_mean, 6) AS tumor_mean, start_bp, end_bp FROM segs")
def m3f(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis = t.filtered(spark, d)
    found = m3.segments_from_pooled(m3.pooled_signal(values, kept, axis, m3.gene_medians(values, kept, axis)), axis, min_seg_genes=5)
    return found.select("segment_id", "chr", "start_idx", "end_idx", "n_genes", r6("tumor_mean").alias("tumor_mean"), "start_bp", "end_bp")


@query("m3g_tumor_mean", BASE + "SELECT t.segment_id, t.chr, round((SELECT avg(s.value) FROM smooth s WHERE NOT s.is_ref AND s.gene_ix >= t.start_idx AND s.gene_ix < t.end_idx) - b.baseline, 6) AS tumor_mean FROM tiles t JOIN base b USING (segment_id)")
def m3g(spark: SparkSession, d: str) -> DataFrame:
    values, kept, axis, med, tiles, cn = t.profiles(spark, d)
    pooled = m3.pooled_signal(values, kept, axis, med)
    mean = pooled.join(axis.select("gene_ix", "chr"), "gene_ix").groupBy("chr").agg(F.avg("value").alias("m"))
    with_mean = tiles.join(mean, "chr").withColumn("tumor_mean", F.col("m")).drop("m")
    return m3.center_tumor_mean(with_mean, m3.reference_baseline(cn, kept)).select("segment_id", "chr", r6("tumor_mean").alias("tumor_mean"))


@query("m3h_segment_means", BASE + "SELECT cell_id, segment_id, round(value, 6) AS value FROM cn")
def m3h(spark: SparkSession, d: str) -> DataFrame:
    signal, _, axis = _smooth(spark, d)
    return m3.segment_means(m3.smoothed(signal, axis, ["cell_id"]), m3.chromosome_tiles(axis), axis).select("cell_id", "segment_id", r6("value").alias("value"))


@query("m3i_baseline", BASE + "SELECT segment_id, round(baseline, 6) AS baseline FROM base")
def m3i(spark: SparkSession, d: str) -> DataFrame:
    _, kept, _, _, _, cn = t.profiles(spark, d)
    return m3.reference_baseline(cn, kept).select("segment_id", r6("baseline").alias("baseline"))


@query("m3j_direct_and_linear", BASE + "SELECT count(*) AS n, 0::BIGINT AS n_apart FROM cn")
def m3j(spark: SparkSession, d: str) -> DataFrame:
    """The partitioned linear path against the dense one: every pair, and how many differ by over 1e-9."""
    values, kept, axis, med, tiles, cn = t.profiles(spark, d)
    dense = m3.segment_means(m3.smoothed(m3.centered(values, kept, axis, med), axis, ["cell_id"]), tiles, axis)
    both = cn.alias("a").join(dense.alias("b"), ["cell_id", "segment_id"])
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a.value") - F.col("b.value")) > 1e-9).alias("n_apart"))


@query("m3k_segment_bounds", BASE + "SELECT segment_id, chr, start_idx::INT AS start_idx, end_idx::INT AS end_idx, n_genes, start_bp, end_bp::BIGINT AS end_bp FROM tiles")
def m3k(spark: SparkSession, d: str) -> DataFrame:
    return m3.chromosome_tiles(t.filtered(spark, d)[2]).select("segment_id", "chr", "start_idx", "end_idx", "n_genes", "start_bp", "end_bp")


@query("m3l_segment_cn", BASE + "SELECT cell_id, segment_id, round(value, 6) AS value FROM cn")
def m3l(spark: SparkSession, d: str) -> DataFrame:
    return t.profiles(spark, d)[5].select("cell_id", "segment_id", r6("value").alias("value"))


# ---- calls -----------------------------------------------------------------------------------------------------------


@query("m4a_weighted_median", EMB + "SELECT cell_id, round(med, 6) AS med FROM wm")
def m4a(spark: SparkSession, d: str) -> DataFrame:
    cn, own, segs = t.matrix(spark, d)
    return m4.weighted_median_rows(m4.deviation(cn, m3.reference_baseline(cn, own), None), segs).select("cell_id", r6("med").alias("med"))


@query("m4b_deviation", EMB + "SELECT cell_id, segment_id, round(value, 6) AS value FROM dev")
def m4b(spark: SparkSession, d: str) -> DataFrame:
    cn, own, segs = t.matrix(spark, d)
    return m4.deviation(cn, m3.reference_baseline(cn, own), segs).select("cell_id", "segment_id", r6("value").alias("value"))


@query("m4c_burden", EMB + "SELECT cell_id, round(burden, 6) AS burden FROM bur")
def m4c(spark: SparkSession, d: str) -> DataFrame:
    return t.scored(spark, d)[2].select("cell_id", r6("burden").alias("burden"))


@query("m4d_template", EMB + "SELECT segment_id, round(t, 6) AS t FROM tem")
def m4d(spark: SparkSession, d: str) -> DataFrame:
    cn, own, segs = t.matrix(spark, d)
    dev = m4.deviation(cn, m3.reference_baseline(cn, own), segs)
    return m4.template_of(dev, m4.burden(dev, segs)).select("segment_id", r6("t").alias("t"))


@query("m4e_projection", EMB + "SELECT cell_id, round(score, 6) AS score FROM sco")
def m4e(spark: SparkSession, d: str) -> DataFrame:
    return t.scored(spark, d)[2].select("cell_id", r6("score").alias("score"))


@query("m4f_low_complexity", BASE + ", det AS (SELECT k.cell_id, count(v.gene_ix) AS detected FROM kept k LEFT JOIN (SELECT * FROM vals WHERE value <> 0) v USING (cell_id) GROUP BY 1) SELECT cell_id, detected < 0.95 * (SELECT median(detected) FROM det) AS low_complexity FROM det")
def m4f(spark: SparkSession, d: str) -> DataFrame:
    values, kept, _ = t.filtered(spark, d)
    return m4.low_complexity(m1.detected_genes(values, kept), 0.95)


@query("m4g_coherence", EMB + "SELECT cell_id, round(coherent, 6) AS coherent FROM coh")
def m4g(spark: SparkSession, d: str) -> DataFrame:
    return t.scored(spark, d)[2].select("cell_id", r6("coherent").alias("coherent"))


@query(
    "m4h_winsor_fence",
    EMB + """, p AS (SELECT quantile_cont(score, 0.01) AS lo, quantile_cont(score, 0.99) AS hi, quantile_cont(score, 0.25) FILTER (is_ref) AS q25, quantile_cont(score, 0.75) FILTER (is_ref) AS q75 FROM scored)
    SELECT cell_id, round(least(greatest(score, lo), hi), 6) AS clipped, score < q25 - 0.6 * (q75 - q25) OR (NOT is_ref AND score > q75 + 0.6 * (q75 - q25) AND coherent < 0.45) AS fenced FROM scored CROSS JOIN p""",
)
def m4h(spark: SparkSession, d: str) -> DataFrame:
    """Bounds and fences, with a narrow fence (0.6) so that both sides are met."""
    s = t.scored(spark, d)[2]
    return m4.winsor_and_fences(s, 0.6).select("cell_id", r6("clipped").alias("clipped"), "fenced")


@query("m4h_mixture_calls", EMB + ", marks AS (SELECT * FROM scored)" + sql.mixture_calls() + "SELECT cell_id, class, round(confidence, 6) AS confidence FROM mcall")
def m4h_calls(spark: SparkSession, d: str) -> DataFrame:
    return m4.mixture_calls(t.scored(spark, d)[2])[0].select("cell_id", "class", r6("confidence").alias("confidence"))


GATES = EMB + """, g1 AS (SELECT *, CASE WHEN class = 'tumor' AND low_complexity THEN 'uncertain' ELSE class END AS c1 FROM called),
g2 AS (SELECT *, CASE WHEN c1 = 'tumor' AND coherent < 0.45 THEN 'uncertain' ELSE c1 END AS c2 FROM g1),
refs AS (SELECT count(*) FILTER (c2 = 'tumor') AS n, 0.5 * median(score) FILTER (c2 = 'tumor') AS sr, 0.5 * median(burden) FILTER (c2 = 'tumor') AS br FROM g2),
g3 AS (SELECT g2.*, coalesce(n >= 5 AND sr > 0 AND c2 = 'normal' AND NOT low_complexity AND NOT is_ref AND score <= -sr AND burden >= br AND coherent >= 0.2, false) AS anti_aligned FROM g2 CROSS JOIN refs)
"""
GATED = Params(anti_aligned_min_tumor=5, coherence_support=0.2)


def _gated(spark: SparkSession, d: str) -> DataFrame:
    return m4.gates(t.called(spark, d)[2], GATED)


@query("m4i_low_complexity_gate", GATES + "SELECT cell_id, c1 = 'uncertain' AS gated FROM g1")
def m4i(spark: SparkSession, d: str) -> DataFrame:
    c = t.called(spark, d)[2]
    return m4.gates(c, Params(coherence_gate=0.0, anti_aligned_min_tumor=10**9)).select("cell_id", (F.col("class") == "uncertain").alias("gated"))


@query("m4j_coherence_gate", GATES + "SELECT cell_id, c2 AS class FROM g2")
def m4j(spark: SparkSession, d: str) -> DataFrame:
    return m4.gates(t.called(spark, d)[2], Params(anti_aligned_min_tumor=10**9)).select("cell_id", "class")


@query("m4k_anti_alignment_gate", GATES + "SELECT cell_id, anti_aligned, CASE WHEN anti_aligned THEN 'uncertain' ELSE c2 END AS class FROM g3")
def m4k(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("cell_id", "anti_aligned", "class")


@query("m4l_gated_confidence", GATES + "SELECT cell_id, round(CASE WHEN class <> CASE WHEN anti_aligned THEN 'uncertain' ELSE c2 END THEN 1 - confidence ELSE confidence END, 6)::DOUBLE AS confidence FROM g3")
def m4l(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("cell_id", r6("confidence").alias("confidence"))


@query(
    "m4m_relabel",
    """WITH z AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label::VARCHAR) AS r FROM embeddings GROUP BY 1),
    m AS (SELECT vec_id AS cell_id, CASE WHEN r <= 5 THEN label ELSE (SELECT label FROM z WHERE r = 1) END AS c FROM embeddings JOIN z USING (label)),
    o AS (SELECT c, row_number() OVER (ORDER BY count(*) DESC, c::VARCHAR) AS r FROM m GROUP BY 1) SELECT cell_id, 'subclone_' || r AS subclone FROM m JOIN o USING (c)""",
)
def m4m(spark: SparkSession, d: str) -> DataFrame:
    return m4.relabel_clusters(t.matrix(spark, d)[1].select("cell_id", F.col("label").cast("string").alias("cluster")))


@query("m4m_subclones")
def m4m_subclones(spark: SparkSession, d: str) -> DataFrame:
    dev, _, c = t.called(spark, d)
    return m4.subclones(dev, c)


@query("m4n_altered", EMB + "SELECT cell_id, count(*) FILTER (abs(value) > 0.2) AS n_segments_altered FROM dev GROUP BY 1")
def m4n(spark: SparkSession, d: str) -> DataFrame:
    return m4.altered_segments(t.scored(spark, d)[0])


CALLS = "SELECT cell_id, class, round(confidence, 6) AS confidence, round(score, 6) AS tumor_score, n_segments_altered, low_complexity, round(burden, 6) AS cn_burden FROM final JOIN alt USING (cell_id)"


def _calls(p: DataFrame) -> DataFrame:
    """All but the subclones, which come from a graph."""
    return p.select("cell_id", "class", r6("confidence").alias("confidence"), r6("tumor_score").alias("tumor_score"), "n_segments_altered", "low_complexity", r6("cn_burden").alias("cn_burden"))


@query("m4o_calls", EMB + ", who AS (SELECT cell_id, is_ref FROM own), low AS (SELECT cell_id, false AS low_complexity FROM own)" + sql.marks() + sql.mixture_calls() + sql.gated() + CALLS)
def m4o_calls(spark: SparkSession, d: str) -> DataFrame:
    return _calls(m4o(spark, d))


@query("m4o_classify")
def m4o(spark: SparkSession, d: str) -> DataFrame:
    cn, own, segs = t.matrix(spark, d)
    return m4.classify_cells(cn, segs, own.select("cell_id", "is_ref"))[0]


# ---- outputs ---------------------------------------------------------------------------------------------------------

CHR = BASE + ", cm AS (SELECT cell_id, chr, exp(sum(n_genes * (value - (SELECT median(baseline) FROM base))) / sum(n_genes)) AS value FROM cn JOIN tiles USING (segment_id) GROUP BY ALL)\n"


def _chr(spark: SparkSession, d: str) -> DataFrame:
    _, kept, _, _, tiles, cn = t.profiles(spark, d)
    return outputs.chr_matrix(cn, tiles, outputs.pedestal(m3.reference_baseline(cn, kept)))


@query("out1_prediction", EMB + "SELECT cell_id AS barcode, class, round(confidence, 6)::DOUBLE AS confidence, round(score, 6) AS tumor_score, subclone, low_complexity, round(burden, 6) AS cn_burden FROM pred")
def out1(spark: SparkSession, d: str) -> DataFrame:
    p = t.predictions(spark, d)[3]
    return p.select(F.col("cell_id").alias("barcode"), "class", r6("confidence").alias("confidence"), r6("tumor_score").alias("tumor_score"), "subclone", "low_complexity", r6("cn_burden").alias("cn_burden"))


@query("out2_ratio", EMB + "SELECT cell_id, segment_id, round(exp(value), 6) AS value FROM cn")
def out2(spark: SparkSession, d: str) -> DataFrame:
    return outputs.to_ratio(t.matrix(spark, d)[0]).select("cell_id", "segment_id", r6("value").alias("value"))


@query("out3_chr_matrix", CHR + "SELECT cell_id, chr, round(value, 6) AS value FROM cm")
def out3(spark: SparkSession, d: str) -> DataFrame:
    return _chr(spark, d).select("cell_id", "chr", r6("value").alias("value"))


@query("out4_chr_centered", CHR + "SELECT cell_id, chr, round(CASE WHEN m = 0 THEN value ELSE value / m END, 6) AS value FROM (SELECT *, median(value) OVER (PARTITION BY cell_id) AS m FROM cm)")
def out4(spark: SparkSession, d: str) -> DataFrame:
    return outputs.center_chr_matrix(_chr(spark, d)).select("cell_id", "chr", r6("value").alias("value"))


BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query("out11_centered_wide", CHR + "SELECT cell_id, " + ", ".join(f"round(max(value) FILTER (chr = '{b}'), 6) AS \"{b}\"" for b in BRANDS) + " FROM (SELECT cell_id, chr, CASE WHEN m = 0 THEN value ELSE value / m END AS value FROM (SELECT *, median(value) OVER (PARTITION BY cell_id) AS m FROM cm)) GROUP BY 1")
def out11(spark: SparkSession, d: str) -> DataFrame:
    w = outputs.wide_chr_matrix(outputs.center_chr_matrix(_chr(spark, d)), BRANDS)
    return w.select("cell_id", *[(r6(F.col(f"`{b}`")) if b in w.columns else F.lit(None).cast("double")).alias(b) for b in BRANDS])


@query("out5_chr_wide", EMB + "SELECT cell_id, " + ", ".join(f"round(exp(sum(n_genes * value) FILTER (chr = 'chr{i}') / sum(n_genes) FILTER (chr = 'chr{i}')), 6) AS chr{i}" for i in range(1, 9)) + " FROM cn JOIN segs USING (segment_id) GROUP BY 1")
def out5(spark: SparkSession, d: str) -> DataFrame:
    cn, _, segs = t.matrix(spark, d)
    w = outputs.wide_chr_matrix(outputs.chr_matrix(cn, segs))
    return w.select("cell_id", *[r6(c).alias(c) for c in w.columns if c != "cell_id"])


SEG = BASE + """, tum AS (SELECT cell_id, 'subclone_' || region AS clone FROM kept WHERE NOT is_ref)
SELECT 's::' || clone AS "ID", t.chr AS chrom, a."start" AS loc_start, b."end"::BIGINT AS loc_end, (t.end_idx - t.start_idx)::BIGINT AS num_mark, round(median(cn.value - base.baseline), 6) AS seg_mean
FROM cn JOIN tum USING (cell_id) JOIN base USING (segment_id) JOIN tiles t USING (segment_id) JOIN axis a ON a.gene_ix = t.start_idx JOIN axis b ON b.gene_ix = t.end_idx - 1 GROUP BY ALL"""


def _clones(spark: SparkSession, d: str) -> DataFrame:
    _, kept, axis, _, tiles, cn = t.profiles(spark, d)
    calls = kept.select("cell_id", F.when(F.col("is_ref"), "normal").otherwise("tumor").alias("class"), F.when(F.col("is_ref"), "").otherwise(F.concat(F.lit("subclone_"), F.col("region"))).alias("subclone"))
    return outputs.clone_segments(cn, tiles, calls, axis, m3.reference_baseline(cn, kept))


@query("out7_clone_seg", SEG)
def out7(spark: SparkSession, d: str) -> DataFrame:
    s = outputs.seg_table(_clones(spark, d), "s")
    return s.select("ID", "chrom", F.col("`loc.start`").alias("loc_start"), F.col("`loc.end`").alias("loc_end"), F.col("`num.mark`").alias("num_mark"), r6(F.col("`seg.mean`")).alias("seg_mean"))


@query("out6_clone_order", BASE + "SELECT 'subclone_' || region AS clone, row_number() OVER (ORDER BY min(cell_id))::INT AS clone_ix FROM kept WHERE NOT is_ref GROUP BY region")
def out6(spark: SparkSession, d: str) -> DataFrame:
    return _clones(spark, d).select("clone", "clone_ix").distinct()


@query("out8_segments", BASE + "SELECT chr, n_genes, start_bp, end_bp::BIGINT AS end_bp FROM tiles")
def out8(spark: SparkSession, d: str) -> DataFrame:
    return m3.chromosome_tiles(t.filtered(spark, d)[2]).select("chr", "n_genes", "start_bp", "end_bp")


@query("out9_cn_arrays", BASE + "SELECT cell_id, count(*) AS n_segments, round(sum(value * (segment_id + 1)), 6) AS mixed FROM cn GROUP BY 1")
def out9(spark: SparkSession, d: str) -> DataFrame:
    cn = t.profiles(spark, d)[5]
    arrays = cn.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment_id", "value"))), lambda x: x["value"]).alias("cn"))
    return arrays.select("cell_id", F.size("cn").cast("long").alias("n_segments"), r6(F.aggregate(F.transform("cn", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)).alias("mixed"))


DIP = EMB + """, pool AS (SELECT cell_id, burden FROM pred WHERE class = 'normal' AND NOT low_complexity),
refc AS (SELECT cell_id FROM pool WHERE burden <= (SELECT quantile_cont(burden, 0.5) FROM pool)),
rmed AS (SELECT segment_id, median(value) AS m FROM cn WHERE cell_id IN (SELECT cell_id FROM refc) GROUP BY 1),
rrel AS (SELECT cell_id, segment_id, value - m AS value, n_genes::DOUBLE AS w FROM cn JOIN rmed USING (segment_id) JOIN segs USING (segment_id)),
rwm AS (SELECT cell_id, min(value) FILTER (acc >= total / 2) AS med FROM (SELECT *, sum(w) OVER (PARTITION BY cell_id ORDER BY value RANGE UNBOUNDED PRECEDING) AS acc, sum(w) OVER (PARTITION BY cell_id) AS total FROM rrel) GROUP BY 1),
rc AS (SELECT cell_id, segment_id, value - med AS value FROM rrel JOIN rwm USING (cell_id)),
tot AS (SELECT cell_id, sum(abs(value)) AS s FROM rc WHERE cell_id IN (SELECT cell_id FROM refc) GROUP BY 1),
clean AS (SELECT cell_id FROM tot WHERE s <= (SELECT median(s) FROM tot)),
cmed AS (SELECT segment_id, median(value) AS m FROM rc WHERE cell_id IN (SELECT cell_id FROM clean) GROUP BY 1),
spr AS (SELECT segment_id, 1.4826 * median(abs(value - m)) AS spread FROM rc JOIN cmed USING (segment_id) WHERE cell_id IN (SELECT cell_id FROM clean) GROUP BY 1)
"""


@query("out10_denoised", DIP + "SELECT cell_id, segment_id, round(sign(value) * greatest(abs(value) - 0.7 * spread, 0), 6) AS value FROM rc JOIN spr USING (segment_id)")
def out10(spark: SparkSession, d: str) -> DataFrame:
    cn, segs, _, p = t.predictions(spark, d)
    return outputs.reference_relative_signal(cn, p, segs, 0.7).select("cell_id", "segment_id", r6("value").alias("value"))


@query("out12_qc", CHR + "SELECT (SELECT count(*) FROM kept) AS n_cells, (SELECT count(*) FROM axis) AS n_genes, (SELECT count(*) FROM tiles) AS n_segments, (SELECT count(*) FROM kept WHERE is_ref) AS n_normal_reference, (SELECT median(n_genes) FROM tiles) AS median_segment_genes")
def out12(spark: SparkSession, d: str) -> DataFrame:
    _, kept, axis = t.filtered(spark, d)
    tiles = m3.chromosome_tiles(axis)
    return kept.agg(F.count("*").alias("n_cells"), F.count_if("is_ref").alias("n_normal_reference")).crossJoin(axis.agg(F.count("*").alias("n_genes"))).crossJoin(tiles.agg(F.count("*").alias("n_segments"), F.median("n_genes").alias("median_segment_genes")))  # one row each


@query("out14_confident_diploid", DIP + "SELECT cell_id FROM refc")
def out14(spark: SparkSession, d: str) -> DataFrame:
    return outputs.confident_diploid(t.predictions(spark, d)[3])


@query("out15_recentered", DIP + "SELECT cell_id, segment_id, round(value, 6) AS value FROM rc")
def out15(spark: SparkSession, d: str) -> DataFrame:
    cn, segs, _, p = t.predictions(spark, d)
    return outputs.recenter(cn, outputs.confident_diploid(p), segs).select("cell_id", "segment_id", r6("value").alias("value"))


@query("out16_denoise", DIP + "SELECT cell_id, segment_id, round(sign(value) * greatest(abs(value) - spread, 0), 6) AS value FROM rc JOIN spr USING (segment_id)")
def out16(spark: SparkSession, d: str) -> DataFrame:
    cn, segs, _, p = t.predictions(spark, d)
    ref = written(outputs.confident_diploid(p), "diploid")
    return outputs.denoise(written(outputs.recenter(cn, ref, segs), "recentered"), ref).select("cell_id", "segment_id", r6("value").alias("value"))


@query("out17_layout", EMB + ", e AS (SELECT *, sum(n_genes) OVER (ORDER BY chr_rank, segment_id)::BIGINT AS right_edge FROM segs), f AS (SELECT segment_id, chr, right_edge - n_genes AS left_edge, right_edge FROM e) SELECT *, min(left_edge) OVER c AS chr_left, max(right_edge) OVER c AS chr_right, (min(left_edge) OVER c + max(right_edge) OVER c) / 2 AS chr_mid FROM f WINDOW c AS (PARTITION BY chr)")
def out17(spark: SparkSession, d: str) -> DataFrame:
    return outputs.genome_layout(t.matrix(spark, d)[2])


@query("out18_panel_sizes", "WITH g AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), a AS (SELECT count(*) AS m FROM embeddings) SELECT label::INT AS label, greatest(1, round_even(n * 100 / m, 0))::BIGINT AS n FROM g CROSS JOIN a")
def out18(spark: SparkSession, d: str) -> DataFrame:
    return outputs.panel_sample(t.matrix(spark, d)[1], 100, "label").groupBy("label").agg(F.count("*").alias("n"))


@query("out20_panels", DIP + "SELECT class AS panel, count(*) AS n_cells, round(avg(value), 6) AS mean FROM rc JOIN pred USING (cell_id) GROUP BY 1")
def out20(spark: SparkSession, d: str) -> DataFrame:
    cn, segs, _, p = t.predictions(spark, d)
    rc = outputs.recenter(cn, outputs.confident_diploid(p), segs)
    return rc.join(p.select("cell_id", F.col("class").alias("panel")), "cell_id").groupBy("panel").agg(F.count("*").alias("n_cells"), r6(F.avg("value")).alias("mean"))


@query("out20_panel_rows", DIP + "SELECT panel, subclone, count(*) AS n, min(row) AS first, max(row) AS last FROM (SELECT *, (row_number() OVER (PARTITION BY panel ORDER BY subclone) - 1)::INT AS row FROM (SELECT 'references' AS panel, '' AS subclone FROM refc UNION ALL SELECT 'observations', subclone FROM pred WHERE class = 'tumor' AND NOT low_complexity)) GROUP BY ALL")
def out20_rows(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the panels, counted by block; the order in a block is Ward's."""
    cn, segs, _, p = t.predictions(spark, d)
    rows = outputs.panels(outputs.recenter(cn, outputs.confident_diploid(p), segs), p, n_ref=10**9, max_obs=10**9)
    return rows.groupBy("panel", "subclone").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.max("row").alias("last"))


@query("out21_group_runs", "WITH o AS (SELECT vec_id, label::INT AS label, row_number() OVER (ORDER BY vec_id) - 1 AS row, lag(label) OVER (ORDER BY vec_id) AS l FROM embeddings), r AS (SELECT *, sum(CASE WHEN l IS NULL OR l <> label THEN 1 ELSE 0 END) OVER (ORDER BY vec_id) AS run FROM o) SELECT label, min(row)::BIGINT AS first, max(row)::BIGINT AS last FROM r GROUP BY run, label")
def out21(spark: SparkSession, d: str) -> DataFrame:
    r = outputs.group_runs(t.matrix(spark, d)[1], "label", "cell_id")
    return r.select("label", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query("out21_heatmap_values", CHR + "SELECT cell_id, chr, round(log2(greatest(value, 1e-6)), 6) AS value FROM cm")
def out21_values(spark: SparkSession, d: str) -> DataFrame:
    return outputs.heatmap_values(_chr(spark, d)).select("cell_id", "chr", r6("value").alias("value"))


# ---- runs and metrics ------------------------------------------------------------------------------------------------


def _run(spark: SparkSession, d: str):
    own = t.cells(spark, d)
    params = Params(min_genes=100, min_seg_genes=4)
    return run_pipeline(t.counts(spark, d), own.select("cell_id", "region"), t.genes(spark, d).select("gene", "orig_ix"), t.gene_order(spark, d), names=own.where("is_ref").select("cell_id"), params=params)


RUN = (
    POOLED + sql.segments(4) + NUMBERED
    + """, cn2 AS (SELECT cell_id, segment_id, avg(value) AS value FROM smooth JOIN segs ON gene_ix >= start_idx AND gene_ix < end_idx GROUP BY ALL), who AS (SELECT cell_id, is_ref FROM kept),
    det AS (SELECT k.cell_id, count(v.gene_ix) AS detected FROM kept k LEFT JOIN (SELECT * FROM vals WHERE value <> 0) v USING (cell_id) GROUP BY 1), low AS (SELECT cell_id, detected < 0.5 * (SELECT median(detected) FROM det) AS low_complexity FROM det)
    """
    + sql.marks("cn2") + sql.mixture_calls() + sql.gated()
)


@query("api2_calls", RUN + CALLS)
def api2_calls(spark: SparkSession, d: str) -> DataFrame:
    return _calls(_run(spark, d).predictions)


@query("api2_segments", RUN + ", cb AS (SELECT segment_id, median(value) AS m FROM cn2 JOIN who USING (cell_id) WHERE is_ref GROUP BY 1) SELECT segment_id, chr, start_idx, end_idx, n_genes, round(tumor_mean - m, 6) AS tumor_mean, start_bp, end_bp FROM segs JOIN cb USING (segment_id)")
def api2_segments(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).segments.select("segment_id", "chr", "start_idx", "end_idx", "n_genes", r6("tumor_mean").alias("tumor_mean"), "start_bp", "end_bp")


@query("api1_annotated_cells", RUN + "SELECT cells.cell_id, region, class AS cnv_class, round(score, 6) AS cnv_score, round(burden, 6) AS cnv_cn_burden, low_complexity AS cnv_low_complexity FROM cells LEFT JOIN final USING (cell_id)")
def api1_cells(spark: SparkSession, d: str) -> DataFrame:
    return api1(spark, d).select("cell_id", "region", "cnv_class", r6("cnv_score").alias("cnv_score"), r6("cnv_cn_burden").alias("cnv_cn_burden"), "cnv_low_complexity")


@query("api2_run_pipeline")
def api2(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d).predictions


@query("api1_call_cnv")
def api1(spark: SparkSession, d: str) -> DataFrame:
    from .pipeline import call_cnv

    own = t.cells(spark, d).select("cell_id", "region")
    return call_cnv(t.counts(spark, d), own, t.genes(spark, d).select("gene", "orig_ix"), t.gene_order(spark, d), reference_key="region", reference_cat=[0, 1, 2], params=Params(min_genes=100, min_seg_genes=4))[0]


@query("ev1_recalls", EMB + "SELECT round(avg((class = 'tumor')::INT) FILTER (label >= 5), 6) AS tumor_recall, round(avg((class = 'normal')::INT) FILTER (label < 5), 6) AS normal_recall, round(avg((class = 'tumor')::INT) FILTER (label < 5), 6) AS false_tumor_rate FROM called")
def ev1(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.recalls(t.called(spark, d)[2].withColumn("is_tumor", F.col("label") >= 5))
    return r.select(*[r6(c).alias(c) for c in r.columns])


@query("ev2_auc", EMB + ", r AS (SELECT label >= 5 AS pos, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored) SELECT round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6)::DOUBLE AS auc FROM r")
def ev2(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.auc(t.scored(spark, d)[2].withColumn("pos", F.col("label") >= 5), "score", "pos").select(r6("auc").alias("auc"))


PROFILE = CHR + ", bulk AS (SELECT chr, avg(\"start\") % 7 - 3 AS level FROM axis GROUP BY 1), prof AS (SELECT chr, avg(value) AS value FROM cm GROUP BY 1)\n"


def _profile(spark: SparkSession, d: str):
    m = _chr(spark, d).groupBy("chr").agg(F.avg("value").alias("value")).withColumnRenamed("chr", "region")
    bulk = t.filtered(spark, d)[2].groupBy(F.col("chr").alias("region")).agg((F.avg("start") % 7 - 3).alias("value"))
    return m, bulk


@query("ev4_direction_recall", PROFILE + "SELECT round(avg((sign(value - 1) = sign(level))::INT), 6) AS direction_recall FROM prof JOIN bulk USING (chr) WHERE level <> 0")
def ev4(spark: SparkSession, d: str) -> DataFrame:
    m, bulk = _profile(spark, d)
    return evaluate.direction_recall(m.withColumn("value", F.col("value") - 1), bulk.withColumnRenamed("value", "level")).select(r6("direction_recall").alias("direction_recall"))


@query("ev5_bulk_pearson", PROFILE + "SELECT round(corr(log2(greatest(value, 1e-6)), level), 6) AS pearson FROM prof JOIN bulk USING (chr)")
def ev5(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.bulk_correlation(*_profile(spark, d)).select(r6("pearson").alias("pearson"))


@query("ev6_crosstab", EMB + "SELECT class, label, count(*) AS n FROM called GROUP BY ROLLUP (class, label)")
def ev6(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.crosstab(t.called(spark, d)[2], "class", "label")


@query("ev7_pseudobulk", EMB + "SELECT class, chr, round(sum(value * n_genes) / sum(n_genes), 6) AS value FROM cn JOIN called USING (cell_id) JOIN segs USING (segment_id) GROUP BY ALL")
def ev7(spark: SparkSession, d: str) -> DataFrame:
    cn, _, segs = t.matrix(spark, d)
    return evaluate.pseudobulk(cn, t.called(spark, d)[2], segs).select("class", "chr", r6("value").alias("value"))


@query("ev8_locus_segments", BASE + "SELECT p_partkey AS locus, segment_id FROM part JOIN tiles ON p_brand = chr AND p_size * 10 + 3 BETWEEN start_bp AND end_bp")
def ev8(spark: SparkSession, d: str) -> DataFrame:
    loci = t.table(spark, d, "part").select(F.col("p_partkey").alias("locus"), F.col("p_brand").alias("chr"), (F.col("p_size") * 10 + 3).alias("pos"))
    return evaluate.locus_segments(loci, m3.chromosome_tiles(t.filtered(spark, d)[2]))
