"""Line deduplication by pairwise alignment.

Lines that several documents hold point to overlapping documents. Every holder of
such a line is paired with the line's first holder, so a line of n holders makes
n - 1 pairs, whatever n, and not n squared: a rare line finds the few that share
it, a frequent one ties all its holders to one document, and no count decides
which lines may make pairs. A pair is aligned by patience diff over line hashes:
lines unique in both, in their longest common order, are anchors, the gaps between
anchors are aligned the same way, and anchors grow into common blocks. Blocks of
at least ``min_block`` characters go from the later document. Pairs are dealt by
their first document, in parts of at most about ``PART`` where it has very many,
and its lines go to each part once, not to each pair.

A pair can miss a block: its lines may have their first holders elsewhere, or
stand in another order. So the rest is found by the shortest runs of lines that
are blocks: from each line on, and back from each line, such a run is a key, and
every holder of a key but the first loses the run, by a join. The shortest runs of
a common block cover it, so none is left out at any number of holders, and no
group of holders is ever gathered. Nothing is lost: the first document that holds
a line keeps it.

"Later" means a larger (doc_id, row); null ids come first. Lines are compared by
a 64-bit hash and their length, without the white space around them.

Defined results: null counts as empty; an empty text is one empty line and stays;
lines shorter than ``min_line`` characters never point to a document and go only
inside a block; a run is a block if it has ``min_block`` characters and a line of
``min_line``; a repeated row goes as a whole if it is long enough; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, small_batches, staged

MIN_LINE, MIN_BLOCK = 24, 48
#: Pairs of one first document that one group of an aligning task holds.
PART = 250


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (i, j) of two sequences, ascending in both."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        where_a: dict = {}
        for i in range(a0, a1):
            where_a[a[i]] = -1 if a[i] in where_a else i
        where_b: dict = {}
        for j in range(b0, b1):
            where_b[b[j]] = -1 if b[j] in where_b else j
        both = sorted((i, j) for x, i in where_a.items() if i >= 0 and (j := where_b.get(x, -1)) >= 0)
        if not both:
            continue
        # longest increasing run of j
        tops: list[int] = []
        at: list[int] = []
        before = [-1] * len(both)
        for k, (_, j) in enumerate(both):
            p = bisect_left(tops, j)
            before[k] = at[p - 1] if p else -1
            if p == len(tops):
                tops.append(j)
                at.append(k)
            else:
                tops[p], at[p] = j, k
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(both[k])
            k = before[k]
        matched += chain
        ends = [(a1, b1), *chain]
        starts = [*chain, (a0 - 1, b0 - 1)]
        for (e, f), (s, t) in zip(ends, starts, strict=True):
            if e > s + 1 and f > t + 1:
                todo.append((s + 1, e, t + 1, f))
    return sorted(matched)


def common_blocks(a: list, b: list, weight: np.ndarray, least: int) -> list[int]:
    """Positions of ``b`` in aligned runs of at least ``least`` characters."""
    out: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*patience(a, b), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1) and run:
            if weight[run].sum() >= least:
                out += run
            run = []
        run.append(j)
        last = (i, j)
    return out


#: Base of the hash of a run of lines, modulo 2^64.
BASE = np.uint64(0x9E3779B97F4A7C15)


def shortest_runs(h: np.ndarray, n: np.ndarray, at: np.ndarray, min_line: int, min_block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first line, end, key) of the shortest runs that are blocks, from each line on and back from each line.

    Lines of documents lie in a row (hashes h, lengths n); document d has those from at[d] to at[d + 1].
    """
    total = len(h)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    line = np.arange(total)
    chars = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    long = np.flatnonzero(n >= min_line)
    # the first end with enough characters and a long line, and the last start
    after = np.concatenate([long, [total]])[np.searchsorted(long, line)] + 1
    end = np.maximum(np.searchsorted(chars, chars[:-1] + min_block), after)
    before = np.concatenate([[-1], long])[np.searchsorted(long, line, "right")]
    start = np.minimum(np.searchsorted(chars, chars[1:] - min_block, "right") - 1, before)
    on, back = end <= at[1:][doc], start >= at[:-1][doc]
    first, last = np.concatenate([line[on], start[back]]), np.concatenate([end[on], line[back] + 1])
    first, last = np.unique(np.stack([first, last]), axis=1) if len(first) else (first, last)
    # a run's key: its lines' hashes by powers of a base, taken line by line over all runs that are that long
    key = np.zeros(len(first), np.uint64)
    u, live = h.view(np.uint64), np.arange(len(first))
    step = 0
    with np.errstate(over="ignore"):
        while len(live := live[first[live] + step < last[live]]):
            key[live] = (key[live] ^ u[first[live] + step]) * BASE
            key[live] ^= key[live] >> np.uint64(29)
            step += 1
    return doc[first], first - at[:-1][doc[first]], last - at[:-1][doc[first]], key.view(np.int64)


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, part: int = PART) -> DataFrame:
    """One row per document: doc_id, text, h and n (hash and length of each line), gone (positions)."""
    small_batches(docs)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), lines.alias("l"))
    rows = rows.select("rid", "doc_id", "text", F.transform("l", lambda x: F.xxhash64(x, F.char_length(x))).alias("h"), F.transform("l", lambda x: F.char_length(x)).alias("n"))
    rows = staged(rows, "lines-documents")
    held = rows.select("rid", "doc_id", F.explode(F.array_distinct(F.arrays_zip("h", "n"))).alias("x")).select("rid", "doc_id", "x.h", "x.n").where(F.col("n") >= min_line)
    shared = staged(held.groupBy("h", "n").agg(F.count("*").alias("df"), F.min(F.struct("doc_id", "rid")).alias("first")).where("df > 1").select("h", "n", F.col("first.rid").alias("a")), "lines-shared")
    pairs = staged(held.join(shared, ["h", "n"]).where("rid <> a").select("a", F.col("rid").alias("b")).distinct(), "lines-pairs")
    parts = staged(pairs.groupBy("a").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")), "lines-parts")
    # merge joins at every size: these sides hold whole documents' lines and texts, and grow with the input
    of = rows.select("rid", "h", "n")
    later = pairs.join(of.hint("merge"), pairs["b"] == of["rid"]).join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b", "h", "n")
    first = of.join(parts.hint("merge"), of["rid"] == parts["a"]).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("b"), "h", "n")
    dealt = later.unionByName(first).repartition("a", "part").sortWithinPartitions("a", "part", "b")

    def align(batches):
        lines, own = [], None  # of the first document, which comes ahead of its partners
        for batch in batches:
            rid, gone = [], []
            a, parts_, b = (batch.column(i).to_numpy() for i in range(3))
            # row by row: only one pair's lines become Python objects at a time
            (fh, oh), (fn, on) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in batch.columns[3:5])
            for i in range(batch.num_rows):
                h = fh[oh[i] : oh[i + 1]].tolist()
                if b[i] < 0:
                    lines, own = h, (a[i], parts_[i])
                    continue
                assert own == (a[i], parts_[i])
                got = common_blocks(lines, h, fn[on[i] : on[i + 1]], min_block)
                if got:
                    rid.append(b[i])
                    gone.append(np.array(got, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["rid", "gone"])

    aligned = dealt.mapInArrow(align, "rid bigint, gone array<int>").groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    def runs(batches):
        for b in batches:
            (h, at), n = ((b.column(2).flatten().to_numpy(), b.column(2).offsets.to_numpy().astype(np.int64)), b.column(3).flatten().to_numpy())
            own, start, end, key = shortest_runs(h, n, at - at[0], min_line, min_block)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own)), pa.array(key), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["rid", "doc_id", "k", "s", "e"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    keyed = rows.select("rid", "doc_id", "h", "n").mapInArrow(runs, f"rid bigint, doc_id {kind}, k bigint, s int, e int")
    # the first holder by (doc_id, rid); a document's own repeats are no other holder
    blocks = staged(keyed.groupBy("k").agg(F.min(F.struct("doc_id", "rid")).alias("first"), F.max(F.struct("doc_id", "rid")).alias("last")).where("first.rid <> last.rid").select("k", F.col("first.rid").alias("a")), "lines-blocks")
    common = keyed.join(blocks, "k").where("rid <> a").groupBy("rid").agg(F.flatten(F.collect_list(F.sequence("s", F.col("e") - 1))).alias("more"))
    both = aligned.join(common, "rid", "full_outer").select("rid", F.array_distinct(F.concat(F.coalesce("gone", F.array().cast("array<int>")), F.coalesce("more", F.array().cast("array<int>")))).alias("gone"))
    marks = staged(both, "lines-marks")
    return rows.join(marks.hint("merge"), "rid", "left").select("doc_id", "text", "h", "n", "gone")


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_line: int = MIN_LINE, min_block: int = MIN_BLOCK, part: int = PART) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (positions), kept (the text without its removed lines)."""
    marked = removed_lines(docs, id_col, text_col, min_line, min_block, part)
    kind = marked.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for b in (part for batch in batches for part in slices(batch, 1, 1 << 20)):
            n, removed, kept = [], [], []
            for i in range(b.num_rows):
                text, hashes, gone = b.column(1)[i].as_py(), b.column(2)[i].values, b.column(4)[i]
                out = np.zeros(len(hashes), bool)
                if gone.is_valid:
                    out[gone.values.to_numpy()] = True
                n.append(len(hashes))
                removed.append(np.flatnonzero(out).astype(np.int32))
                kept.append(text if not out.any() else "\n".join(x for x, o in zip(text.split("\n"), out, strict=True) if not o))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_removed", "removed", "kept"])

    return marked.mapInArrow(cut, f"doc_id {kind}, n_lines bigint, n_removed bigint, removed array<int>, kept string")
