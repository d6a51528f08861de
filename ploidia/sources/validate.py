"""Are these raw counts? One aggregate over values, one over cells."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import percentiles

ACTIONS = ("warn", "raise", "ignore")
# Tolerance of integers; and what makes library sizes look normalised.
INT_TOL = 1e-6
MIN_CELLS, CV_MAX, TARGET_TOL = 10, 0.01, 0.02
TARGETS = (1e4, 1e6)
REASONS = {
    "negative": "matrix contains negative values",
    "non_finite": "matrix contains non-finite values (NaN or Inf)",
    "fractional": "matrix contains non-integer (fractional) values",
    "uniform": "per-cell library sizes are near-uniform at a canonical target",
}


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def value_facts(counts: DataFrame) -> DataFrame:
    """One row: negative, non_finite, fractional."""
    v = F.col("value")
    return counts.agg(
        F.coalesce(F.bool_or((v < 0) & ~F.isnan(v)), F.lit(False)).alias("negative"),
        F.coalesce(F.bool_or(~_finite(v)), F.lit(False)).alias("non_finite"),
        F.coalesce(F.bool_or(F.when(_finite(v), F.abs(v - F.rint(v)) > INT_TOL)), F.lit(False)).alias("fractional"),
    )


def library_facts(counts: DataFrame) -> DataFrame:
    """One row over cells of positive total: n, cv (population), median."""
    totals = counts.groupBy("cell_id").agg(F.sum("value").alias("t")).where("t > 0")
    facts = totals.agg(F.count("*").alias("n"), F.try_divide(F.stddev_pop("t"), F.avg("t")).alias("cv"))
    return facts.crossJoin(percentiles(totals, "t", {"median": 0.5}))  # one row each


def raw_count_reason_table(counts: DataFrame) -> DataFrame:
    """One row, ``reason``: a key of REASONS, or NULL for raw counts. Checks in order."""
    near = F.lit(False)
    for t in TARGETS:
        near = near | (F.abs(F.col("median") - t) <= TARGET_TOL * t)
    uniform = (F.col("n") >= MIN_CELLS) & (F.col("cv") < CV_MAX) & near
    both = value_facts(counts).crossJoin(library_facts(counts))  # 1 x 1
    return both.select(F.when(F.col("negative"), "negative").when(F.col("non_finite"), "non_finite").when(F.col("fractional"), "fractional").when(uniform, "uniform").alias("reason"))


def raw_count_reason(counts: DataFrame) -> str | None:
    found = raw_count_reason_table(counts).first()["reason"]
    return REASONS.get(found)


def looks_like_raw_counts(counts: DataFrame) -> bool:
    return raw_count_reason(counts) is None


def is_already_normalized(counts: DataFrame) -> bool:
    return bool(counts.agg(F.coalesce(F.min("value"), F.lit(0.0)) < 0).first()[0])


def validate_raw_counts(counts: DataFrame, action: str = "warn", has_counts_layer: bool = False) -> None:
    if action not in ACTIONS:
        raise ValueError(f"raw_count_check must be one of {', '.join(ACTIONS)}")
    if action == "ignore" or has_counts_layer:
        return
    reason = raw_count_reason(counts)
    if reason and action == "raise":
        raise ValueError(f"not raw counts: {reason}")
    if reason:
        warnings.warn(f"not raw counts: {reason}", stacklevel=2)
