"""What several operators share: scratch tables, text rules, packed blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: ASCII white space: blank and 0x09-0x0D.
SPACE = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a laptop) a local master gets a folder
    of its own; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="ploidia-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/ploidia/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the byte path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, SPACE), "")


def small_batches(df: DataFrame, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows for this session's Python operators: a batch holds whole texts."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan, to scale partition counts with the input; where it has none, the bytes of all text."""
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if found < 1 << 60:
        return found
    texts = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return int(sum(df.agg(*texts).first())) if texts else df.count()


def blocks_for(df: DataFrame, block_bytes: int) -> int:
    """Number of blocks in proportion to the input; at least 12."""
    return max(12, -(-input_bytes(df) // block_bytes))


def to_payload(table: pa.Table) -> bytes:
    """An Arrow stream compressed with zstd."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_payload(payload) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload) if isinstance(payload, bytes) else payload).read_all()


def payloads(held: list[pa.RecordBatch]):
    """(block, payload) of the batches' rows by their column __block; empties ``held``, so that rows are held once."""
    table = pa.Table.from_batches(held).combine_chunks()
    held.clear()
    at = table.column("__block").to_numpy()
    table = table.drop_columns(["__block"])
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.diff(at[order], prepend=-1))
    for s, e in zip(starts, [*starts[1:], len(order)], strict=True):
        payload = to_payload(table.take(pa.array(order[s:e])))
        yield pa.RecordBatch.from_arrays([pa.array([at[order[s]]], pa.int64()), pa.array([payload], pa.binary())], names=["block", "payload"])


def packed_blocks(df: DataFrame, n_blocks: int, *key: str, flush_bytes: int = 32 << 20) -> DataFrame:
    """(block, payload): the rows of ``df`` by hash of ``key``, as zstd Arrow streams that shuffle small.

    A row's block depends on its key alone, so a lost task yields the same blocks
    again; with the text in the key, many rows of one id lie in many blocks.
    """

    def pack(batches):
        tidy()  # the worker may come from an operator that took more
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            del b
            if size >= flush_bytes:
                yield from payloads(held)
                size = 0
                tidy()
        if held:
            yield from payloads(held)
        tidy()

    small_batches(df)
    keyed = df.withColumn("__block", F.pmod(F.xxhash64(*key), F.lit(n_blocks)))
    return keyed.mapInArrow(pack, "block bigint, payload binary")


def tidy() -> None:
    """Gives memory that the last group left free back to the system: workers live on, and share an executor with the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def unpacked(group: pa.Table) -> pa.Table:
    """The rows of all payloads of one block."""
    tidy()
    return pa.concat_tables([from_payload(x.as_buffer()) for x in group.column("payload")]).combine_chunks()


def slices(batch: pa.RecordBatch, column: int, limit: int):
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text is a run by itself."""
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
