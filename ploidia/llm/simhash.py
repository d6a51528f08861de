"""SimHash near-duplicate detection with covering locality-sensitive hashing.

A document's fingerprint is the 64-bit SimHash of its word shingles, hashed in
the JVM and summed bit by bit over Arrow batches. Bit i of the fingerprint gets
a non-zero vector m(i) of radius+1 bits; mask v, for each of the 2^(radius+1)-1
non-zero v, keeps the bits with <m(i), v> = 1. Any at most ``radius`` differing
bits leave some v orthogonal to all their vectors, so every pair within the
radius agrees on a whole mask: no link is missed and none is left to chance.

Only distinct fingerprints enter the tables, so copies cost nothing there. In a
table, rows of one key are compared blockwise and give a spanning set of links,
never all pairs. Components follow by rounds of minimum labels with pointer
jumping, each round a written table; nothing is gathered on the driver.

Defined results: null and empty texts have fingerprint 0; fewer words than a
shingle make one shingle of them all; null doc_id is a document like any other
but never names a component if another id can; repeated rows each return a row;
empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, small_batches, staged, tidy, words_of

#: Rows of one key compared at once: BLOCK x BLOCK popcounts.
BLOCK = 1024
#: Keys of at most so many rows give all their links, others a spanning set: either connects the same rows.
FEW = 8


def shingle_hashes(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id and the XXH64 (seed 42) of every k-word shingle, repeats included."""
    small_batches(docs)
    words = docs.select(F.col(f"`{id_col}`").alias("doc_id"), words_of(ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("w"))
    gram = lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(F.col("w"), i + j) for j in range(1, k)]))
    starts = F.slice("w", F.lit(1), F.size("w") - (k - 1))
    return words.select("doc_id", F.when(F.size("w") >= k, F.transform(starts, gram)).when(F.size("w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "w")))).otherwise(F.array().cast("array<bigint>")).alias("h"))


def simhash_batch(h: pa.ListArray) -> np.ndarray:
    """Signed 64-bit fingerprints of a batch of hash lists: bit set if set in over half."""
    h = h.combine_chunks() if isinstance(h, pa.ChunkedArray) else h
    offsets = h.offsets.to_numpy().astype(np.int64)
    flat = h.values.to_numpy(zero_copy_only=False).view(np.uint64)
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full) == 0:
        return out.view(np.int64)
    starts = (offsets[full] - offsets[0]).astype(np.int64)
    flat = flat[offsets[0] : offsets[-1]]
    # eight bits at a time: each byte of a word counts one of eight bit positions, in runs short enough not to overflow
    half = n[full]
    for b in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(b)) & np.uint64(1)).astype(np.int32), starts)
        out[full] |= (2 * ones > half).astype(np.uint64) << np.uint64(b)
    return out.view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(simhash_batch(b.column(1)))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""
    h = shingle_hashes(docs, id_col, text_col, k)
    kind = h.schema["doc_id"].dataType.simpleString()
    return h.mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


@lru_cache(maxsize=8)
def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of the covering family, as signed longs."""
    width = radius + 1
    size = (1 << width) - 1
    # any vectors cover; those are taken that leave the lightest mask heaviest, so that no table is coarse
    step = max((m for m in range(1, size + 1) if math.gcd(m, size) == 1), key=lambda m: min(sum((1 + i * m % size & v).bit_count() & 1 for i in range(bits)) for v in range(1, size + 1)))
    vectors = [1 + i * step % size for i in range(bits)]
    masks = []
    for v in range(1, 1 << width):
        m = sum(1 << i for i in range(bits) if (vectors[i] & v).bit_count() & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of signed fingerprints; as unsigned, since numpy counts the bits of absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _spanning_links(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within one key that connect what all its pairs within the radius connect."""
    links = []
    # grow components from a seed block: each fingerprint is compared with unvisited ones only
    unseen = fps.copy()
    while len(unseen):
        front, unseen = unseen[:1], unseen[1:]
        while len(front) and len(unseen):
            f, front = front[:BLOCK], front[BLOCK:]
            hit = np.zeros(len(unseen), bool)
            by = np.zeros(len(unseen), np.int64)
            for at in range(0, len(unseen), BLOCK):
                apart = distance(unseen[None, at : at + BLOCK], f[:, None])
                nearest = apart.argmin(0)
                hit[at : at + BLOCK] = apart[nearest, np.arange(apart.shape[1])] <= radius
                by[at : at + BLOCK] = f[nearest]
            if hit.any():
                links.append((unseen[hit], by[hit]))
                front, unseen = np.concatenate([front, unseen[hit]]), unseen[~hit]
    return links


def _links_of(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        kept: list[np.ndarray] = []

        def flush(t, k, f):
            out = []
            new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
            starts, ends = np.concatenate([[0], new]), np.concatenate([new, [len(t)]])
            size = ends - starts
            # keys with few rows: compare at each distance along the run, all runs at once
            small = np.repeat(size <= FEW, size)
            group = np.repeat(np.arange(len(size)), size)
            for lag in range(1, min(FEW, len(f))):
                same = small[lag:] & (group[lag:] == group[:-lag])
                if not same.any():
                    break
                i = np.flatnonzero(same)
                i = i[distance(f[i], f[i + lag]) <= radius]
                out.append((f[i], f[i + lag]))
            for s, e in zip(starts[size > FEW], ends[size > FEW], strict=True):
                out += _spanning_links(f[s:e], radius)
            a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        for batch in batches:
            t, k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if len(t) == 0:
                continue
            if kept:
                t, k, f = (np.concatenate(x) for x in zip(kept, (t, k, f), strict=True))
            last = (t == t[-1]) & (k == k[-1])
            cut = int(len(t) - last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield flush(t[:cut], k[:cut], f[:cut])
            kept = [t[cut:], k[cut:], f[cut:]]
        if kept and len(kept[0]):
            yield flush(*kept)

    return run


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links a > b between distinct fingerprints (column fp) that connect every pair within the radius."""
    masks = covering_masks(radius)
    # a small table becomes one row a mask: spread it first, or a few tasks make all rows
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.repartition(parts, "fp").select(F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("x"), "fp").select("x.t", "x.k", "fp")
    dealt = keyed.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
    return dealt.mapInArrow(_links_of(radius), "a bigint, b bigint").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node reachable. Min labels along links, then pointer jumping, until nothing moves.

    nodes(node), edges(a, b). Each round is a written table.
    """
    both = staged(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        # link: the smallest label among neighbours; hook: a root takes the smallest label offered to it
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near"))
        hooks = step.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("hook"))
        hooked = step.join(hooks, F.col("label") == F.col("root")).select("node", F.col("label").alias("was"), F.least("near", "hook").alias("label"))
        hooked = staged(hooked, "cc-hook")
        parent = hooked.select(F.col("node").alias("p"), F.col("label").alias("up"))
        jumped = staged(hooked.join(parent, F.col("label") == F.col("p"), "left").select("node", "was", F.coalesce("up", "label").alias("label")), "cc-jump")
        moved = not jumped.where("was <> label").isEmpty()
        labels = jumped.select("node", "label")
        if not moved:
            break
    return nodes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, fingerprint (hex), component_id, the smallest doc_id reachable."""
    fp = staged(fingerprints(docs, id_col, text_col, k), "simhash-fp")
    classes = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-classes")
    found = staged(links(classes.select("fp"), radius), "simhash-links")
    labels = components(classes.select(F.col("fp").alias("node")), found).withColumnRenamed("node", "fp")
    member = classes.join(labels, "fp")
    least = member.groupBy("label").agg(F.min("least").alias("component_id"))
    named = member.join(least, "label").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
