"""Table schemas; column order is part of the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame

COUNTS = "cell_id string, gene string, value double"
CELLS = "cell_id string, cell_ix long"
GENES = "gene string, gene_ix int, chr string, chr_rank int, start long, end long"
GENE_ORDER = "gene_symbol string, chr string, start long, end long"
SEGMENTS = "chr string, start_idx int, end_idx int, n_genes int, tumor_mean double, segment_id int, start_bp long, end_bp long"
PREDICTION = "cell_id string, class string, confidence double, tumor_score double, subclone string, n_segments_altered long, low_complexity boolean, cn_burden double"
CLONES_SEG = "ID string, chrom string, `loc.start` long, `loc.end` long, `num.mark` long, `seg.mean` double"


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
