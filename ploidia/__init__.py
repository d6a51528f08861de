"""Copy-number inference from single-cell counts, as Spark DataFrame plans."""

from __future__ import annotations

__version__ = "0.1.0"

from .plans.pipeline import call_cnv, run_pipeline
from .sources.counts import load_counts

__all__ = ["__version__", "call_cnv", "load_counts", "run_pipeline"]
