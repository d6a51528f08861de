"""Text inputs: Matrix Market, axes, gene order, GTF, lists and signature libraries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.genome import AUTOSOMES, CYCLE_GENES, NON_MALIGNANT, SIGNATURES, chr_rank

LOW = (1 << 33) - 1


def row_index(df: DataFrame, name: str = "ix") -> DataFrame:
    """Adds the 0-based row number in file order, without gathering rows: rows are counted by partition first."""
    marked = df.withColumn("__m", F.monotonically_increasing_id())
    counts = marked.groupBy(F.shiftright("__m", 33).alias("__p")).agg(F.count("*").alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # one row a partition
    return marked.withColumn("__p", F.shiftright("__m", 33)).join(before, "__p").withColumn(name, (F.col("__b") + F.col("__m").bitwiseAND(LOW)).cast("long")).drop("__p", "__b", "__m")


def matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value), 0-based, repeated coordinates summed; ``.gz`` by suffix."""
    lines = spark.read.text(str(path)).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = lines.agg(F.min(F.struct("at", "m", "value")).alias("first")).select("first.*")
    if (first := size.first())["value"] is None:
        raise ValueError(f"{path}: no size line")
    # a size line has three numbers like any entry; it is told by its place
    part = F.split(F.trim("value"), r"\s+")
    entries = lines.where((F.col("at") != first["at"]) | (F.col("m") != first["m"]))
    return entries.select((F.get(part, F.lit(0)).cast("long") - 1).alias("row"), (F.get(part, F.lit(1)).cast("long") - 1).alias("col"), F.coalesce(F.get(part, F.lit(2)).cast("double"), F.lit(1.0)).alias("value")).groupBy("row", "col").agg(F.sum("value").alias("value"))


def matrix_shape(spark: SparkSession, path: str) -> tuple[int, int]:
    lines = spark.read.text(str(path)).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("m")).where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    first = lines.agg(F.min(F.struct("at", "m", "value")).alias("f")).first()["f"]
    rows, cols = first["value"].split()[:2]
    return int(rows), int(cols)


def axis_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV axis: its first column becomes ``key`` (text, never a number), others stay; plus ``ix``."""
    df = spark.read.csv(str(path), header=True, inferSchema=False)
    first = df.columns[0]
    return row_index(df.select(F.col(f"`{first}`").alias(key), *[F.col(f"`{c}`") for c in df.columns[1:]]))


def gene_order(spark: SparkSession, path: str) -> DataFrame:
    """gene_symbol, chr, chr_rank, start, end in genomic order; unknown contigs have NULL chr and come last."""
    df = spark.read.csv(str(path), sep="\t", header=True, schema="gene_symbol string, chr string, start long, end long")
    return ordered_genes(df)


def ordered_genes(df: DataFrame) -> DataFrame:
    rank = chr_rank(F.col("chr"))
    return df.select("gene_symbol", F.when(rank.isNotNull(), F.col("chr")).alias("chr"), rank.alias("chr_rank"), "start", "end").orderBy(F.col("chr_rank").asc_nulls_last(), "start")


def symbol_list(spark: SparkSession, path: str, name: str = "symbol") -> DataFrame:
    """Distinct lines, stripped; blank and ``#`` lines don't count."""
    return symbols_of(spark.read.text(str(path)), name)


def symbols_of(lines: DataFrame, name: str = "symbol") -> DataFrame:
    """The same from lines in ``value``."""
    return lines.select(F.trim("value").alias(name)).where((F.col(name) != "") & ~F.col(name).startswith("#")).distinct()


def cycle_genes(spark: SparkSession, path: str | None = None) -> DataFrame:
    return symbol_list(spark, path) if path else spark.createDataFrame([(g,) for g in CYCLE_GENES], "symbol string")


def barcode_list(spark: SparkSession, path: str) -> DataFrame:
    return symbol_list(spark, path, "cell_id")


def signature_library(path: str | None = None) -> tuple[dict[str, list[str]], list[str]]:
    """(library in order, labels taken as diploid)."""
    if path is None:
        return dict(SIGNATURES), list(NON_MALIGNANT)
    raw = json.loads(Path(path).read_text())
    meta = raw.pop("_meta", {})
    return checked_signatures(raw, meta.get("non_malignant_labels"))


def checked_signatures(library: dict[str, list[str]], labels: list[str] | None = None) -> tuple[dict[str, list[str]], list[str]]:
    if not library:
        raise ValueError("the signature library is empty")
    labels = list(library) if labels is None else list(labels)
    if unknown := [x for x in labels if x not in library]:
        raise ValueError(f"labels without a signature: {', '.join(unknown)}")
    return library, labels


def signature_table(spark: SparkSession, library: dict[str, list[str]]) -> DataFrame:
    """label_ix, label, gene; one row a distinct gene of a label."""
    rows = [(i, label, g) for i, (label, genes) in enumerate(library.items()) for g in dict.fromkeys(genes)]
    return spark.createDataFrame(rows, "label_ix int, label string, gene string")


def gene_table_from_gtf(lines: DataFrame) -> DataFrame:
    """From GTF lines (``value``, ``ix``): one row a symbol, its longest span, the first on ties, in genomic order."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select("ix", f.alias("f")).where((F.size("f") == 9) & (F.get("f", F.lit(2)) == "gene"))
    rows = rows.select("ix", F.regexp_extract(F.get("f", F.lit(8)), r'gene_name "([^"]*)"', 1).alias("gene_symbol"), F.get("f", F.lit(0)).alias("chr"), F.get("f", F.lit(3)).cast("long").alias("start"), F.get("f", F.lit(4)).cast("long").alias("end"))
    rows = rows.where(F.col("chr").isin(*AUTOSOMES, "chrX", "chrY") & (F.col("gene_symbol") != ""))
    longest = Window.partitionBy("gene_symbol").orderBy((F.col("end") - F.col("start")).desc(), "ix")
    one = rows.withColumn("rn", F.row_number().over(longest)).where("rn = 1")
    return one.select("gene_symbol", "chr", "start", "end").orderBy(chr_rank(F.col("chr")), "start", "gene_symbol")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return gene_table_from_gtf(spark.read.text(str(path)).select("value", F.monotonically_increasing_id().alias("ix")))
