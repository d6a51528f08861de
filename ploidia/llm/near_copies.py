"""Dropping near copies: SimHash candidates, and an exact judgement of each link.

Two texts are linked if their sets of ``k``-word shingles (by 64-bit hash) have a
Jaccard similarity of at least ``similarity``; groups are components of links.

Covering SimHash comes first: fingerprints within the radius meet in some table,
whatever the pair, and give a spanning set of candidates, each of which is judged
on all shingles. A similarity of 0.8 lies some ten bits apart, though, where
covering would take thousands of tables; so what lies beyond the radius meets by
bands of minima of the same shingle hashes: ``ROWS`` minima make a band, and two
sets of similarity s share one of ``BANDS`` bands with probability
1 - (1 - s^ROWS)^BANDS, which is 0.9998 at 0.8. Where holders of a band are of
different groups so far, all their pairs are judged where they meet, with their
whole sets, and only a spanning forest of links that hold leaves the task: no
link is lost behind a text that is like neither, and no list of pairs is made.

Sets are made for those texts only that share a band or a candidate with another.
A band of very many holders is dealt in blocks, each with each, so a group is
never held as a whole; holders that are of one group already are left out.

Defined results: of a group the document with the smallest id stays, null last;
null and empty texts are alike; rows equal in id and text are one document, and
stay or go together; rows keep all their columns; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged, tidy
from .simhash import components, links, shingle_hashes, simhash_batch

ROWS, BANDS = 4, 16
#: Holders of a band that meet in one group, with as many of another block.
TOGETHER = 1000
#: Places of the table that tells which texts are wanted as sets; it only saves shuffling the others.
PLACES = 1 << 22

with np.errstate(over="ignore"):
    _MULTIPLIERS = np.random.default_rng(29).integers(1, 1 << 63, ROWS * BANDS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def bands(h: pa.ListArray) -> np.ndarray:
    """Keys of the bands of each list of hashes, [rows, BANDS]; lists without any have keys of their own."""
    at = h.offsets.to_numpy().astype(np.int64)
    flat = h.values.to_numpy(zero_copy_only=False).view(np.uint64)[at[0] : at[-1]]
    n = np.diff(at)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), BANDS), np.uint64)
    starts = at[:-1][full] - at[0]
    with np.errstate(over="ignore"):
        mixed = (flat ^ (flat >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        for j, m in enumerate(_MULTIPLIERS):
            band = j // ROWS
            if len(full):
                low = np.minimum.reduceat((mixed * m) >> np.uint64(32), starts)
                out[full, band] = (out[full, band] ^ low) * np.uint64(0x9E3779B97F4A7C15)
                out[full, band] ^= out[full, band] >> np.uint64(29)
        out += np.arange(BANDS, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tidy()
    for b in batches:
        h = b.column(2)
        keys = bands(h)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(simhash_batch(h)), lists], names=["doc_id", "print", "fp", "bands"])
    tidy()


def _wanted(keys: DataFrame) -> np.ndarray:
    """A bit for each place that a key (column x) of ``keys`` has: a table of fixed size, whatever their number."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(PLACES, bool)
        for b in batches:
            bits[b.column(0).to_numpy() & (PLACES - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(PLACES // 8, np.uint8)
        for b in batches:
            for x in b.column(0):
                bits |= np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], names=["bits"])

    few = keys.mapInArrow(mark, "bits binary").repartition(8).mapInArrow(either, "bits binary").collect()  # eight rows of 0.5 MB
    out = np.zeros(PLACES // 8, np.uint8)
    for r in few:
        out |= np.frombuffer(r["bits"], np.uint8)
    return out


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have that Jaccard similarity, on all shingles; two empty sets are alike."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")).hint("merge"), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("ha", "hb")).alias("c"), (F.size("ha") + F.size("hb")).alias("n"))
    return sized.where((F.col("n") == 0) | (F.col("c") >= F.lit(similarity) * (F.col("n") - F.col("c")) - 1e-9)).select("a", "b")


def forest(label: np.ndarray, side: np.ndarray, flat: np.ndarray, at: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between sets that connect what all pairs of at least that similarity connect.

    Set i holds flat[at[i] : at[i + 1]] and belongs to group label[i] so far. If
    there are two sides, only pairs across them are judged.
    """
    n, size = len(label), np.diff(at)
    root = np.unique(label, return_inverse=True)[1]  # group of each set, kept up to date
    across = bool((side != side[0]).any())
    _, code = np.unique(flat, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner = np.repeat(np.arange(n), size)[order]
    starts = np.searchsorted(code[order], np.arange(int(code.max(initial=-1)) + 2))
    out = []
    for i in range(1, n):
        if (root[:i] == root[i]).all():
            continue
        own = code[at[i] : at[i + 1]]
        run = starts[own + 1] - starts[own]
        ends = np.cumsum(run)
        met = owner[np.repeat(starts[own] - (ends - run), run) + np.arange(int(ends[-1]) if len(ends) else 0)]
        common = np.bincount(met, minlength=n)[:i]
        total = size[:i] + size[i]
        fits = (common >= similarity * (total - common) - 1e-9) & (root[:i] != root[i])
        if across:
            fits &= side[:i] != side[i]
        for j in np.flatnonzero(fits):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, int(j)))
    return out


def _forests(similarity: float):
    """Rows (k, i, j, side, node, label, h) in order of k, i, j: a forest of links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()

        def group(rows: pa.Table):
            node, label, side = (rows.column(c).to_numpy() for c in ("node", "label", "side"))
            h = rows.column("h").combine_chunks()
            h = pa.concat_arrays(h.chunks) if isinstance(h, pa.ChunkedArray) else h
            at = h.offsets.to_numpy().astype(np.int64)
            found = forest(label, side, h.values.to_numpy()[at[0] : at[-1]], at - at[0], similarity)
            if found:
                a, b = (node[list(x)] for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if kept is None else pa.concat_tables([kept, t])
            keys = np.stack([t.column(c).to_numpy() for c in ("k", "i", "j")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            starts = [0, *cuts.tolist()]
            for s, e in zip(starts, starts[1:], strict=False):
                yield from group(t.slice(s, e - s))
            kept = t.slice(starts[-1])
        if kept is not None:
            yield from group(kept)
        t = kept = None
        tidy()  # not all workers of this stage are used by the next ones

    return run


def near_links(docs: DataFrame, text: str, id_: str, k: int, radius: int, similarity: float, together: int = TOGETHER) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct documents (node, doc_id, print), and links a > b between nodes that connect every group."""
    key = [F.col(f"`{id_}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("print"), F.col(f"`{text}`").alias("text")]
    base = docs.select(*key)
    h = shingle_hashes(base.select(F.struct("doc_id", "print").alias("key"), "text"), "key", "text", k).select("doc_id.doc_id", "doc_id.print", "h")
    kind = h.schema["doc_id"].dataType.simpleString()
    rows = h.mapInArrow(_signed, f"doc_id {kind}, print bigint, fp bigint, bands array<bigint>")
    nodes = staged(rows.groupBy("doc_id", "print").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands")).select(F.monotonically_increasing_id().alias("node"), "*"), "near-nodes")

    # candidates of the covering tables: one for each fingerprint, and each document of a fingerprint with its first
    classes = staged(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "near-classes")
    found = staged(links(classes.select("fp"), radius).groupBy("a").agg(F.min("b").alias("b")), "near-covered")
    head = classes.select("fp", "head")
    across = found.join(head.select(F.col("fp").alias("a"), F.col("head").alias("u")), "a").join(head.select(F.col("fp").alias("b"), F.col("head").alias("v")), "b").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
    within = nodes.select("fp", "node").join(classes.where("n > 1").select("fp", "head"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = staged(across.unionByName(within), "near-pairs")

    # bands of several holders
    held = nodes.select("node", F.explode("bands").alias("k"))
    shared = held.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    holders = staged(held.join(shared, "k").select("k", "node"), "near-holders")

    # whole sets of the documents concerned
    concerned = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(holders.select("node")).distinct()
    concerned = staged(nodes.select("node", "doc_id", "print").join(concerned, "node"), "near-concerned")
    bits = docs.sparkSession.sparkContext.broadcast(_wanted(concerned.select(F.xxhash64("doc_id", "print").alias("x"))))

    @F.arrow_udf("boolean")
    def wanted(x: pa.Array) -> pa.Array:
        at = x.to_numpy(zero_copy_only=False) & (PLACES - 1)
        return pa.array((bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1)

    some = base.where(wanted(F.xxhash64("doc_id", "print")))
    sets = shingle_hashes(some.select(F.struct("doc_id", "print").alias("key"), "text"), "key", "text", k).select("doc_id.doc_id", "doc_id.print", F.array_distinct("h").alias("h"))
    sets = sets.groupBy("doc_id", "print").agg(F.first("h").alias("h")).alias("s").join(concerned.alias("c"), F.col("s.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("s.print") == F.col("c.print"))).select("c.node", "s.h")
    sets = staged(sets, "near-sets")

    covered = staged(similar(pairs, sets, similarity), "near-judged")
    labels = components(concerned.select("node"), covered)
    named = staged(holders.join(labels, "node").select("k", "node", "label"), "near-named")
    open_ = staged(named.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(F.count("*") / together).cast("int").alias("blocks")).where("low < high").select("k", "blocks"), "near-open")
    dealt = named.join(open_, "k").select("k", "node", "label", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "label")
    full = dealt.join(sets.hint("merge"), "node").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "node").select("k", "i", "j", "side", "node", "label", "h")
    rest = full.mapInArrow(_forests(similarity), "a bigint, b bigint").distinct()
    return nodes.select("node", "doc_id", "print"), staged(covered.unionByName(rest), "near-edges")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, radius: int = 6, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies one document, that with the smallest id."""
    nodes, edges = near_links(docs, text_col, id_col, k, radius, similarity)
    labels = components(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct(), edges)
    member = staged(nodes.join(labels, "node"), "near-members")
    first = staged(member.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("best")), "near-first")
    gone = staged(member.join(first, "label").where("node <> best.node").select("doc_id", "print"), "near-gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("print"))
    return rows.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("d.print") == F.col("g.print")), "left_anti").select("row.*")
