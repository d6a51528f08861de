"""Removal of long repeated byte strings with a run-length index.

A byte goes if a string of ``length`` bytes that covers it also starts in an
earlier document. Every such string has a minimizer, the least of the hashes of
its k-grams, and equal strings have equal minimizers; consecutive strings that
share one lie in one stretch of text. Stretches are dealt by minimizer, so equal
strings meet in one part whatever documents they are in, and a part's size is set
by the number of parts. Minimizers that stand in one document only are left out
first, by exchanging their hashes alone.

A part holds each distinct stretch once, with its smallest document. Of those that
are not alone with their minimizer it builds a run-length index: suffixes sorted, the Burrows-Wheeler transform in runs,
suffix positions sampled at both ends of each run, and the rows at which suffixes
begin to differ within ``length`` bytes, with the smallest document of each such
group. These stretches are then streamed through it together, right to left, as any
pattern would be: a byte that the row's run holds maps the row, another one moves
to the nearest run of that byte above or below whose sampled suffix agrees longer,
and the matched length follows. Where it reaches ``length`` bytes, the row's group
tells the smallest document that holds the string. Copies of a passage are one
stretch in the index, so a passage in thousands of documents costs as much as one
in two, and one group never gathers in one task.

Documents travel once, as compressed blocks by hash of their id, and take the
answers back block by block. Hashes choose where strings meet, never whether they
are equal: that is decided on bytes.

Defined results: null counts as empty; texts under ``length`` bytes keep all;
rows of equal doc_id don't count as earlier than one another, so repeated rows of
one id keep all that no smaller id has; a null id is later than all others; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ASKED, RADIX, Meeting, flat_column
from .shared import blocks_for, from_payload, packed_blocks, to_payload, unpacked

LENGTH = 50
#: Bytes of a k-gram: windows have length - K + 1 of them.
K = 17
#: Stored input bytes of a block.
BLOCK_BYTES = 3 << 20
#: Windows whose minimizers are worked out at once.
PIECE = 1 << 15
LATE = np.iinfo(np.int64).max


# ---- stretches of a block --------------------------------------------------------------------------------------------


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """A 56-bit hash of the K bytes from every position (K between 17 and 24)."""
    n = len(data) - K + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = lambda i: np.ndarray((n,), "<u8", data, i, (1,))
    with np.errstate(over="ignore"):
        h = at(0) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h += at(8)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h += at(K - 8)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h >> np.uint64(8)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive hashes, by doubling."""
    have, m = 1, h
    while 2 * have <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(h) - w + 1], m[w - have : w - have + len(h) - w + 1]) if have < w else m


@dataclass
class Stretches:
    """Runs of windows of one minimizer in a block: first window, number of windows, document, minimizer."""

    data: np.ndarray
    starts: np.ndarray  # of documents
    first: np.ndarray
    windows: np.ndarray
    doc: np.ndarray
    value: np.ndarray


def stretches(texts: pa.Array, length: int) -> Stretches:
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(texts) and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    starts = bounds - bounds[0]
    z = np.zeros(0, np.int64)
    if len(data) < length:
        return Stretches(data, starts, z, z, z, z.astype(np.uint64))
    n = np.maximum(0, np.diff(starts) - length + 1)  # windows of each document
    full = n > 0
    total = len(data) - length + 1
    begins = starts[:-1][full]
    firsts, values = [], []
    last = np.uint64(0)
    # a piece at a time, so that what it needs stays in the processor's cache
    for at in range(0, total, PIECE):
        end = min(at + PIECE, total)
        m = window_minima(kgram_hashes(data[at : end + length - 1]), length - K + 1)
        new = np.empty(len(m), bool)
        new[0] = at == 0 or m[0] != last
        np.not_equal(m[1:], m[:-1], out=new[1:])
        last = m[-1]
        new[begins[np.searchsorted(begins, at) : np.searchsorted(begins, end)] - at] = True
        f = np.flatnonzero(new)
        firsts.append(f + at)
        values.append(m[f])
    first, value = np.concatenate(firsts), np.concatenate(values)
    doc = np.searchsorted(starts, first, "right") - 1
    inside = first < starts[doc] + n[doc]  # not those windows that run into the next document
    first, value, doc = first[inside], value[inside], doc[inside]
    end = np.minimum(np.append(first[1:], total), starts[doc] + n[doc])
    return Stretches(data, starts, first, end - first, doc, value)


def pack_sorted(v: np.ndarray) -> bytes:
    """Ascending numbers as zstd of the byte planes of their differences."""
    d = np.diff(v, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def values_of(s: Stretches, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct minimizers of a block, ascending; whether two documents of it have them; and each stretch's place among them. order: rank of each document."""
    at = np.argsort(s.value)
    v, d = s.value[at], order[s.doc[at]]
    new = np.empty(len(v), bool)
    new[:1] = True
    np.not_equal(v[1:], v[:-1], out=new[1:])
    place = np.empty(len(v), np.int64)
    place[at] = np.cumsum(new) - 1
    cut = np.flatnonzero(new)
    if not len(cut):
        return v, np.zeros(0, bool), place
    return v[cut], np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut), place


def gathered(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The slices of data as a binary array."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    flat = data[np.repeat(first - (ends - size), size) + np.arange(total)] if total else np.zeros(0, np.uint8)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def distinct_stretches(s: Stretches, shared: np.ndarray, ids: np.ndarray, length: int):
    """Distinct stretches, of those that ``shared`` flags, in byte order, with the smallest document id; and which occurrences have which."""
    use = np.flatnonzero(shared)
    coded = gathered(s.data, s.first[use], s.windows[use] + length - 1).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(use) else np.zeros(0, np.int64)
    least = np.full(len(order), LATE)
    np.minimum.at(least, code, ids[s.doc[use]])
    return use, code, coded.dictionary.take(pa.array(order)), least


# ---- the run-length index --------------------------------------------------------------------------------------------


def sorted_suffixes(t: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, new): positions of all suffixes in order, each by its bytes up to its string's end, then by position;
    and where the first ``length`` bytes differ from the row before.

    ``ends`` are the places of the end bytes. Doubling compares 8, 16, ... bytes,
    among suffixes that are still alike only, and stops when the longest string is
    compared as a whole. A rank is the first row of the suffixes alike so far.
    """
    n = len(t)
    left = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)).astype(np.int32)  # bytes before the end
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, 0, (1,)).astype(np.uint64)
    short = np.flatnonzero(left < 8)
    drop = np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64))
    key[short] = np.where(left[short] > 0, key[short] >> (drop & np.uint64(63)) << (drop & np.uint64(63)), np.uint64(0))
    # equal bytes of unequal lengths (zero bytes inside strings) are told apart by length
    plain = np.count_nonzero(t == 0) == len(ends)
    rows = np.argsort(key) if plain else np.lexsort((np.minimum(left, 8), key))
    key = key[rows]
    differs = np.empty(n + 1, bool)
    differs[0] = differs[n] = True
    np.not_equal(key[1:], key[:-1], out=differs[1:n])
    if not plain:
        size = np.minimum(left, 8)[rows]
        differs[1:n] |= size[1:] != size[:-1]
    rank = np.empty(n, np.int32)
    rank[rows] = np.maximum.accumulate(np.where(differs[:n], np.arange(n, dtype=np.int32), 0))
    have, longest = 8, int(left.max()) if n else 0
    level, kept = have, rank  # ranks of the longest power that fits in ``length``
    alike = rows[~(differs[:n] & differs[1:])]  # in row order: those whose rank another one shares
    whole = []  # of them, those compared to their ends
    while have < longest and len(alike):
        ended = left[alike] < have
        whole.append(alike[ended])
        alike = alike[~ended]
        if level == have:
            rank = rank.copy()
        old = rank[alike]
        after = rank[alike + have] + 1
        both = old.astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        order = np.argsort(both)
        alike, both = alike[order], both[order]
        own = np.empty(len(alike) + 1, bool)
        own[0] = own[-1] = True
        np.not_equal(both[1:], both[:-1], out=own[1:-1])
        old = (both >> np.uint64(32)).astype(np.int32)
        group = np.empty(len(alike), bool)
        group[:1] = True
        np.not_equal(old[1:], old[:-1], out=group[1:])
        at = np.arange(len(alike), dtype=np.int32)
        place = old + at - np.maximum.accumulate(np.where(group, at, 0))  # rows of a rank lie side by side
        rank[alike] = np.maximum.accumulate(np.where(own[:-1], place, 0))
        rows[place] = alike
        alike = alike[~(own[:-1] & own[1:])]
        have *= 2
        if have <= length:
            level, kept = have, rank
    alike = np.concatenate([*whole, alike])
    if len(alike):  # wholly alike: by position
        both = np.sort(rank[alike].astype(np.uint64) << np.uint64(32) | alike.astype(np.uint64))
        old, alike = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
        group = np.empty(len(alike), bool)
        group[:1] = True
        np.not_equal(old[1:], old[:-1], out=group[1:])
        at = np.arange(len(alike))
        rows[old + at - np.maximum.accumulate(np.where(group, at, 0))] = alike
    if have <= length:
        level, kept = length, rank  # all are told apart
    # two windows of ``level`` bytes cover ``length``; shorter suffixes are never asked for, and stand alone
    first = kept[rows]
    second = np.where(left[rows] >= length, kept[np.minimum(rows + (length - level), n - 1)], -1 - rows)
    new = np.empty(n, bool)
    new[:1] = True
    new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    return rows, new


class Marks:
    """Marked rows of n, as bits with a count every 64: which mark is the last at or before a row."""

    def __init__(self, at: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64, bool)
        bits[at] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def last(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        low = self.words[word] & (~np.uint64(0) >> (np.uint64(63) - (row & 63).astype(np.uint64)))
        return self.before[word] + np.bitwise_count(low) - 1


class RunIndex:
    """Run-compressed transform of strings that each end in a zero byte.

    Kept per run: its byte, first row, where its first row maps to, and the
    suffix positions at its first and last row; per group of suffixes alike in
    ``length`` bytes, its first row and the least weight of their strings. Any
    bytes may stand in strings and patterns.
    """

    def __init__(self, strings: pa.Array, length: int, weight: np.ndarray):
        ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
        body = np.frombuffer(strings.buffers()[2], np.uint8)
        size = np.diff(ends)
        at = np.cumsum(size + 1) - size - 1
        t = np.zeros(int((size + 1).sum()), np.uint8)
        where = np.repeat(at - (ends[:-1] - ends[0]), size) + np.arange(int(size.sum()))
        t[where] = body[ends[0] : ends[-1]]
        self.length, self.n = length, len(t)
        rows, new = sorted_suffixes(t, at + size, length)
        # bytes count from 1; the end of the string before a first byte is 0, which no pattern has
        self.text = t.astype(np.int16) + np.int16(1)
        self.text[at + size] = 0
        bwt = self.text[rows - 1]
        head = np.flatnonzero(np.diff(bwt, prepend=bwt[:1] + np.int16(1)))
        self.run_start, self.run_byte = head, bwt[head]
        run_len = np.diff(np.append(head, self.n))
        order = np.argsort(self.run_byte, kind="stable")
        self.run_map = np.empty(len(head), np.int64)
        self.run_map[order] = np.cumsum(run_len[order]) - run_len[order]
        self.run_end = np.append(head[1:], self.n) - 1
        self.start_position, self.end_position = rows[head], rows[self.run_end]
        # the runs of each byte in order, to find the nearest ones
        self.of_byte = order
        self.run_key = self.run_byte[order].astype(np.int64) * (len(head) + 1) + order
        self.byte_at = np.searchsorted(self.run_byte[order], np.arange(258))
        self.runs, group_start = Marks(head, self.n), np.flatnonzero(new)
        self.groups = Marks(group_start, self.n)
        self.group_least = np.minimum.reduceat(np.repeat(weight, size + 1)[rows], group_start)

    def _agree(self, body: np.ndarray, at: np.ndarray, most: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How many bytes of a pattern at body[at], of at most ``most``, agree with the text at ``position``."""
        out = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            k = out[live]
            place = position[live] + k
            same = (place < self.n) & (body[at[live] + k] == self.text[np.minimum(place, self.n - 1)])
            live = live[same]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def stream(self, patterns: pa.Array, batch: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
        """(first, out): for every place of every pattern with ``length`` bytes to its right, the least weight of a string that holds those bytes, or LATE.

        Patterns go through the index together, each from its end; ``first`` says
        where in ``out`` a pattern's places begin. The matched length is that of
        the pattern's suffix at the row's own suffix, at most ``length``.
        """
        bounds = np.frombuffer(patterns.buffers()[1], np.int64)[patterns.offset : patterns.offset + len(patterns) + 1]
        body = np.frombuffer(patterns.buffers()[2] or b"", np.uint8).astype(np.int16) + np.int16(1)
        size = np.diff(bounds)
        places = np.maximum(0, size - self.length + 1)
        first = np.cumsum(places) - places
        out = np.full(int(places.sum()), LATE)
        by_size = np.argsort(-size, kind="stable")
        for start in range(0, len(by_size), batch):
            own = by_size[start : start + batch]
            left, at = size[own].copy(), bounds[own + 1].copy()  # bytes to go, and the place of what is matched
            row, position, matched = np.zeros(len(own), np.int64), np.full(len(own), self.start_position[0]), np.zeros(len(own), np.int64)
            while True:
                live = int(np.searchsorted(-left, 0, "left"))  # lengths descend
                if not live:
                    break
                left, at, row, position, matched, own = left[:live] - 1, at[:live], row[:live], position[:live], matched[:live], own[:live]
                byte = body[at - 1]
                run = self.runs.last(row)
                off = np.flatnonzero(self.run_byte[run] != byte)
                if len(off):
                    run, row, position, matched = self._jump(off, byte, run, row, position, matched, body, at)
                row = self.run_map[run] + row - self.run_start[run]
                position = position - 1
                matched = np.minimum(matched + 1, self.length)
                at = at - 1
                whole = np.flatnonzero(matched >= self.length)
                out[first[own[whole]] + left[whole]] = self.group_least[self.groups.last(row[whole])]
        return first, out

    def _jump(self, off, byte, run, row, position, matched, body, at):
        """Rows whose run holds another byte go to the nearest run of theirs, above or below, by the longer agreement with the samples there."""
        own = byte[off].astype(np.int64)
        low, high = self.byte_at[own], self.byte_at[own + 1]
        # the next run of the byte after this one
        below = np.searchsorted(self.run_key, own * (len(self.run_start) + 1) + run[off])
        has_below, has_above = below < high, below > low
        r_below, r_above = self.of_byte[np.minimum(below, len(self.of_byte) - 1)], self.of_byte[np.maximum(below - 1, 0)]
        most = matched[off]
        n_below = np.where(has_below, self._agree(body, at[off], np.where(has_below, most, 0), self.start_position[r_below]), -1)
        n_above = np.where(has_above, self._agree(body, at[off], np.where(has_above, most, 0), self.end_position[r_above]), -1)
        down = n_below > n_above
        chosen = np.where(down, r_below, r_above)
        absent = ~has_below & ~has_above  # a byte that the text has not: nothing is matched, and the row stays where it may begin again
        run, row, position, matched = run.copy(), row.copy(), position.copy(), matched.copy()
        run[off] = np.where(absent, run[off], chosen)
        row[off] = np.where(absent, self.run_start[run[off]], np.where(down, self.run_start[chosen], self.run_end[chosen]))
        position[off] = np.where(absent, self.start_position[run[off]], np.where(down, self.start_position[chosen], self.end_position[chosen]))
        matched[off] = np.where(absent, -1, np.maximum(n_below, n_above))
        return run, row, position, matched


# ---- the operator ----------------------------------------------------------------------------------------------------


def _pack_minimizers(items: pa.Table) -> bytes:
    return to_payload(pa.table({"v": [pack_sorted(items.column("v").to_numpy())], "twice": [np.packbits(items.column("twice").to_numpy()).tobytes()]}))


def _unpack_minimizers(payload) -> pa.Table:
    row = from_payload(payload)
    v = unpack_sorted(row.column("v")[0].as_py())
    return pa.table({"v": v, "twice": np.unpackbits(np.frombuffer(row.column("twice")[0].as_py(), np.uint8), count=len(v)).astype(bool)})


def _met_minimizers(tables: list[pa.Table]) -> tuple[pa.Table, list[np.ndarray]]:
    """Distinct minimizers, ascending, and whether two documents have them."""
    distinct, where = np.unique(np.concatenate([t.column("v").to_numpy() for t in tables]), return_inverse=True)
    times = np.bincount(where, weights=1 + np.concatenate([t.column("twice").to_numpy() for t in tables]), minlength=len(distinct))
    cuts = np.cumsum([0] + [t.num_rows for t in tables])
    return pa.table({"v": distinct, "twice": times > 1}), [where[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def minimizers_of(strings: pa.Array, length: int | None = None) -> np.ndarray:
    """The minimizer of all windows of each stretch: they share one, so that of the first window, whatever the stretch's size. Without ``length``, windows are of the shortest string's."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    out = np.empty(len(strings), np.uint64)
    if not len(out):
        return out
    length = length or int(np.diff(ends).min())
    body = np.frombuffer(strings.buffers()[2], np.uint8)
    windows = np.ndarray((int(ends[-1]) - length + 1, length), np.uint8, body, 0, (1, 1))
    step = PIECE // (2 * length)  # a piece at a time, so that what it needs stays in the processor's cache
    for at in range(0, len(out), step):
        start = ends[at : min(at + step, len(out))]
        first = np.zeros(len(start) * length + K - 1, np.uint8)
        first[: len(start) * length].reshape(-1, length)[:] = windows[start]
        out[at : at + step] = kgram_hashes(first).reshape(-1, length)[:, : length - K + 1].min(1)
    return out


def _met_stretches(tables: list[pa.Table]) -> tuple[pa.Table, list[np.ndarray]]:
    """Distinct stretches in byte order, each with its smallest document."""
    coded = pa.concat_arrays([c for t in tables for c in t.column("s").chunks]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[coded.indices.to_numpy(zero_copy_only=False)]
    least = np.full(len(order), LATE)
    np.minimum.at(least, code, np.concatenate([t.column("d").to_numpy() for t in tables]))
    cuts = np.cumsum([0] + [t.num_rows for t in tables])
    return pa.table({"s": coded.dictionary.take(pa.array(order)), "d": least}), [code[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, radix: int = RADIX) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: the maximal removed runs), kept (the bytes that stay)."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    n = blocks_for(docs, block_bytes)
    blocks = packed_blocks(base, n, "doc_id", "text")

    def answer(items: pa.Table) -> pa.Table:
        """Of each stretch, the places from which another document is the smallest that holds the bytes there."""
        strings, weight = flat_column(items, "s"), items.column("d").to_numpy()
        # stretches that share bytes have one minimizer: one that is alone with its own shares none, and its document is the smallest throughout
        _, which, times = np.unique(minimizers_of(strings, length), return_inverse=True, return_counts=True)
        alone = times[which] == 1
        indexed = strings.filter(pa.array(~alone))
        first, found = RunIndex(indexed, length, weight[~alone]).stream(indexed) if len(indexed) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        new = np.diff(found, prepend=found[:1] ^ 1) != 0
        new[first] = True
        at = np.flatnonzero(new)
        bounds = np.append(np.searchsorted(at, first), len(at))
        whose = np.searchsorted(first, at, "right") - 1
        singles = int(alone.sum())
        bounds = np.concatenate([np.arange(singles), singles + bounds])
        back = np.argsort(np.argsort(~alone, kind="stable"))  # those alone come first in what follows
        lists = lambda one, other: pa.LargeListArray.from_arrays(bounds, pa.array(np.concatenate([one, other]))).take(pa.array(back))
        return pa.table({"at": lists(np.zeros(singles, np.int32), (at - first[whose]).astype(np.int32)), "d": lists(weight[alone], found[at])})

    by_value = Meeting(n, lambda items: items.column("v").to_numpy(), _met_minimizers, lambda items: pa.table({"shared": items.column("twice")}), _pack_minimizers, _unpack_minimizers, radix)
    by_stretch = Meeting(n, lambda items: minimizers_of(flat_column(items, "s"), length), _met_stretches, answer, radix=radix)

    def opened(group: pa.Table):
        rows = unpacked(group)
        ids = pc.fill_null(rows.column("doc_id"), LATE).to_numpy()
        return rows, ids, stretches(flat_column(rows, "text"), length)

    def values(s: Stretches, ids: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        value, twice, place = values_of(s, np.unique(ids, return_inverse=True)[1])
        return pa.table({"v": value, "twice": twice}), place

    def minimizers(group: pa.Table) -> pa.Table:
        _, ids, s = opened(group)
        return by_value.ask(values(s, ids)[0], group.column("block")[0].as_py())

    def shared_of(s: Stretches, ids: np.ndarray, found: pa.Table) -> np.ndarray:
        items, place = values(s, ids)
        told = by_value.told(items, found)
        return np.zeros(0, bool) if told is None else told.column("shared").to_numpy()[place]

    def shared_stretches(group: pa.Table, found: pa.Table) -> pa.Table:
        _, ids, s = opened(group)
        _, _, strings, least = distinct_stretches(s, shared_of(s, ids, found), ids, length)
        return by_stretch.ask(pa.table({"s": strings, "d": least}), group.column("block")[0].as_py())

    def cut(group: pa.Table, found: pa.Table) -> pa.Table:
        rows, ids, s = opened(group)
        kind = found.column("kind").to_numpy()
        use, code, strings, _ = distinct_stretches(s, shared_of(s, ids, found.filter(pa.array(kind == 0))), ids, length)
        told = by_stretch.told(pa.table({"s": strings}), found.filter(pa.array(kind == 1)))
        size = np.zeros(len(strings), np.int64)
        size[code] = s.windows[use]
        begin = np.cumsum(size) - size
        if told is None:
            least = np.zeros(0, np.int64)
        else:
            at = flat_column(told, "at")
            change = at.flatten().to_numpy() + np.repeat(begin, np.diff(at.offsets.to_numpy()))
            least = np.repeat(flat_column(told, "d").flatten().to_numpy(), np.diff(np.append(change, int(size.sum()))))
        # each occurrence's windows: gone if an earlier document has the string
        k = s.windows[use]
        ends = np.cumsum(k)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - k, k)
        gone = least[np.repeat(begin[code], k) + step] < np.repeat(ids[s.doc[use]], k)
        start = (np.repeat(s.first[use], k) + step)[gone]
        # windows start at different places: a byte goes if one starts in the ``length`` places up to it
        begun = np.zeros(len(s.data) + 1, np.int32)
        begun[start + 1] = 1
        np.cumsum(begun, out=begun)
        out = begun[1:] > 0
        out[length:] = begun[length + 1 :] > begun[1 : max(1, len(begun) - length)]
        edge = out.copy()
        edge[1:] &= ~out[:-1]
        inner = s.starts[:-1][np.diff(s.starts) > 0]
        edge[inner] = out[inner]
        last = out.copy()
        last[:-1] &= ~out[1:]
        ending = s.starts[1:][np.diff(s.starts) > 0] - 1
        last[ending] = out[ending]
        a, b = np.flatnonzero(edge), np.flatnonzero(last) + 1
        doc = np.searchsorted(s.starts, a, "right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - s.starts[doc]), pa.array(b - s.starts[doc])], names=["start", "end"]))
        kept_n = np.concatenate([[0], np.cumsum(~out)])[s.starts]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(kept_n.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(s.data[~out]))])
        return pa.table({"doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(s.starts)), "spans": spans, "kept": kept.cast(pa.binary())})

    shared = by_value.meet(blocks.groupBy("block").applyInArrow(minimizers, ASKED))
    asked = blocks.groupBy("block").cogroup(shared.groupBy("to_grp")).applyInArrow(shared_stretches, ASKED)
    every = shared.withColumn("kind", F.lit(0)).unionByName(by_stretch.meet(asked).withColumn("kind", F.lit(1)))
    return blocks.groupBy("block").cogroup(every.groupBy("to_grp")).applyInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
