"""Mixing sources to target weights by blocks of fixed length.

Each source's words are one stream, cut into blocks of ``block`` words. Every
output shard draws how many of its slots each source gets: multinomial draws on
the condition that all shards together give each source its target number of
blocks. The draws halve the shards again and again, each half seeded by its
place, so any executor works out any shard's counts by itself, and the counts
before it, without a pass over the others. Slot k of a source takes the block
that a pseudorandom permutation of the source's block indices gives for k, a new
permutation for each pass over the source; blocks and slots meet by index.

A source of a third of all rows is spread over hashed lanes, whose lengths are
summed first, so no window or task holds a whole source. Lane and place in it go
by the document's id and a hash of its text, never by how rows are dealt, so any
file layout gives the same mix. One number per source reaches the driver and
every drawing task; a corpus has few sources, its hosts don't count as such.

Targets: a source weighs as its place in code point order tells (null last), and
a target stops at ``cap`` times its source's size, the excess shared again by
weight until none is above. A block is taken at most ``cap`` times if ``cap`` is
whole, so no document exceeds ``cap`` times its size.

Defined results: null and empty texts have size 0 and are never taken; a null
source is a source; rows of equal doc_id are documents of their own; reruns
agree for the same seed; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, staged, tidy

BLOCK = 128
SLOTS = 8192
CAP = 3
WEIGHTS = (1, 2, 3)
#: Lanes of a source: a lane of 10^10 documents holds a few millions of them, and a lane is what one task sorts.
LANES = 4096


def word_count(text):
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("bigint")


def targets_of(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; excess goes round by weight."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def shard_counts(shard: int, shards: int, counts: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in this shard, and in all shards before it)."""
    before, lo, hi = np.zeros_like(counts), 0, shards
    total = int(counts.sum())
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = min(total, (mid - lo) * slots)
        if left < total:
            draw = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(counts, left, method="marginals")
        else:
            draw = counts.copy()
        if shard < mid:
            counts, hi, total = draw, mid, left
        else:
            before, counts, lo, total = before + draw, counts - draw, mid, total - left
    return counts, before


def permuted(k: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds, walked until inside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rounds = [np.uint64(x) for x in np.random.default_rng(key).integers(1, 1 << 62, 4, dtype=np.int64)]

    def once(x):
        a, b = x >> np.uint64(half), x & mask
        for r in rounds:
            z = (b ^ r) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((z >> np.uint64(32)) & mask)
        return (a << np.uint64(half)) | b

    with np.errstate(over="ignore"):
        x = once(k.astype(np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


class Mix:
    """What a mix is made of: ``documents``, ``spans`` and ``slots``, as written tables.

    documents: rid, doc_id, print (a hash of the text), source_ix, size, offset (in its source's stream)
    spans:     rid, source_ix, block, first (word of the document), words
    slots:     shard, slot, source_ix, block
    sources:   list of (source, size, weight, target, blocks, slots)
    """

    def __init__(self, docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", block=BLOCK, slots=SLOTS, cap=CAP, weights=WEIGHTS, lanes=LANES, seed=17):
        spark = docs.sparkSession
        sized = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), word_count(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(f"`{text_col}`").alias("print"), F.monotonically_increasing_id().alias("rid"))
        sized = staged(sized, "mix-sizes")
        # rid only tells rows apart that agree in all else, and so may change places
        by_lane = Window.partitionBy("source", "lane").orderBy("doc_id", "print", "size", "rid")
        lanes_of = sized.withColumn("lane", F.pmod(F.xxhash64("doc_id", "print"), F.lit(lanes)).cast("int")).withColumn("within", F.coalesce(F.sum("size").over(by_lane.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        totals = lanes_of.groupBy("source", "lane").agg(F.sum("size").alias("n"))
        bases = totals.select("source", "lane", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

        found = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()  # one row per source
        found = sorted(((r[0], int(r[1])) for r in found), key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
        weigh = [weights[i % len(weights)] for i in range(len(found))]
        total = sum(n for _, n in found)
        target = targets_of([n for _, n in found], weigh, total, cap)
        blocks = [-(-n // block) for _, n in found]
        # slots in proportion to whole blocks; a short last block counts as it is on average
        take = [min(cap * b, round(t * b / n)) if n else 0 for t, b, (_, n) in zip(target, blocks, found, strict=True)]
        self.sources = [(s, n, w, t, b, k) for (s, n), w, t, b, k in zip(found, weigh, target, blocks, take, strict=True)]
        frame = spark.createDataFrame([(i, s, n, float(w), float(t), b, k) for i, (s, n, w, t, b, k) in enumerate(self.sources)], "source_ix int, source string, source_size bigint, weight double, target double, blocks bigint, slots bigint")
        self.source_table = frame
        placed = lanes_of.alias("d").join(bases.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.lane") == F.col("b.lane"))).select("d.rid", "d.doc_id", "d.print", "d.source", "d.size", (F.col("within") + F.col("base")).cast("bigint").alias("offset"))
        self.documents = placed.alias("d").join(frame.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_ix", "s.source_size", "s.target")
        self.spans = self.documents.where("size > 0").select(
            "rid", "source_ix", "size", "offset", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block))).alias("block")
        ).select("rid", "source_ix", "block", F.greatest(F.lit(0), F.col("block") * block - F.col("offset")).alias("first"), (F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("offset", F.col("block") * block)).alias("words"))

        counts, sizes = np.array(take, np.int64), np.array(blocks, np.int64)
        shards = max(1, math.ceil(int(counts.sum()) / slots))

        def draw(batches):
            for b in batches:
                for shard in b.column(0).to_pylist():
                    own, before = shard_counts(shard, shards, counts.copy(), slots, seed)
                    ix = np.repeat(np.arange(len(own)), own)
                    k = np.concatenate([np.arange(f, f + n) for f, n in zip(before, own, strict=True)] or [np.zeros(0, np.int64)])
                    at = np.empty(len(k), np.int64)
                    for s in np.flatnonzero(own):
                        mine = np.flatnonzero(ix == s)
                        for turn in np.unique(k[mine] // sizes[s]):
                            sel = mine[k[mine] // sizes[s] == turn]
                            at[sel] = permuted(k[sel] % sizes[s], int(sizes[s]), [seed, int(s), int(turn)])
                    slot = np.random.default_rng([seed, 1, shard]).permutation(len(k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), shard, np.int64)), pa.array(slot.astype(np.int64)), pa.array(ix.astype(np.int32)), pa.array(at)], names=["shard", "slot", "source_ix", "block"])
            tidy()

        # written, so that the planner knows its true size: it would broadcast what it believes as small as the range of shards
        self.slots = staged(spark.range(0, shards if counts.sum() else 0, 1, max(1, min(shards, 1 << 14))).mapInArrow(draw, "shard bigint, slot bigint, source_ix int, block bigint"), "mix-slots")

    def taken(self) -> DataFrame:
        """doc_id, rid, size, source, source_size, target, taken: words that the mix takes, repeats counted."""
        times = self.slots.groupBy("source_ix", "block").agg(F.count("*").alias("times"))
        words = self.spans.join(times, ["source_ix", "block"]).groupBy("rid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        return self.documents.join(words, "rid", "left").select("doc_id", "print", "rid", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))

    def pieces(self) -> DataFrame:
        """The mixed output: shard, slot, rid, first, words; the documents' words that fill each slot."""
        return self.slots.join(self.spans, ["source_ix", "block"]).select("shard", "slot", "rid", "first", "words")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, **how) -> DataFrame:
    """``docs`` mixed in whole documents: a document comes as often as the mix takes its words, on average.

    taken / size is rounded up with a probability of its fraction, by a hash of
    the document, so each source's words still come near its target and no
    document comes more than ``cap`` times. Documents without words don't come.
    """
    mix = Mix(docs, id_col, text_col, source_col, seed=seed, **how)
    size, source = "__size", "__source"
    share = F.col("taken") / F.col("size")
    u = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "source"), F.lit(1 << 30)) / float(1 << 30)
    # rows that agree in id, source and size may share a fate: their words are pooled
    pooled = mix.taken().where("size > 0").groupBy("doc_id", "source", "size").agg(F.avg("taken").alias("taken")).select("doc_id", "source", "size", F.floor(share + u).cast("int").alias("copies")).where("copies > 0")
    pooled = staged(pooled, "mix-copies")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias(source), word_count(F.col(f"`{text_col}`")).alias(size))
    # a merge join at every size: the copies' table grows with the documents
    joined = own.alias("d").join(pooled.hint("merge").alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col(f"d.{source}").eqNullSafe(F.col("m.source")) & (F.col(f"d.{size}") == F.col("m.size")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
