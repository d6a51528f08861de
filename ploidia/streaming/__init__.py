"""The copy-number caller has no event-time operators: no windows, watermarks or state.

What arrives over time is more cells. ``counts_stream`` reads new count files as
they land; each cell stands in one file, so the per-cell operators (cell filter,
normalisation, detected genes, raw-count checks) run on each micro-batch as they
do on a table, and the run-wide ones on what the sink has gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import COUNTS


def counts_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(COUNTS).option("maxFilesPerTrigger", max_files).parquet(folder)


def append_batches(stream: DataFrame, transform, out: str, checkpoint: str):
    """Runs ``transform`` on every micro-batch and appends to ``out``; a batch that is replayed overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
