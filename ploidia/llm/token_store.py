"""Token-id output as bit-plane shuffled chunks.

Documents are sorted by id into shards (range partitions). A shard's ids run on
in chunks of a fixed number of ids. A chunk is transposed into bit planes, plane
b holding bit b of every id, each plane compressed with zstandard; high planes
are nearly constant and shrink to almost nothing. The store is a table in the
shared folder with one row per chunk: shard, chunk and first id make the chunk
index, which columnar reads fetch without the payload, and the row also lists
the documents that start in it. Writers commit through Spark, so tasks that are
retried or speculated leave no stray chunks, and any file system will do.

Texts are encoded by segment: white space with the letters or marks that follow.
Byte-level pre-tokenizers of this family never join a word to the white space
after it, nor letters to marks, so equal segments have equal ids, and each
distinct segment of a batch is encoded once.

Defined results: null counts as empty, which still has its end id; rows of equal
id follow one another by text, null ids come last; an empty table gives an empty
store; other columns are not read.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks_for, slices, small_batches, staged

#: Ids in a chunk.
CHUNK = 1 << 16
#: Stored input bytes that make a shard.
SHARD_BYTES = 16 << 20
LEVEL = 3
#: Bytes of text encoded at once.
SLICE = 2 << 20
#: Segments joined to one text for the library, and segments a worker remembers.
TOGETHER, REMEMBERED = 200, 250_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=4)
def _special(path: str) -> list[str]:
    return [x.content for x in _tokenizer(path).get_added_tokens_decoder().values()]


@lru_cache(maxsize=2)
def _known(path: str) -> dict[bytes, bytes]:
    """Ids of segments this worker has met: saves time only, and holds no more than REMEMBERED."""
    return {}


def _encode_segments(segments: list[bytes], path: str) -> list[bytes]:
    """Ids of each segment, as little-endian bytes.

    Many segments go to the library as one text with a special token between:
    it splits at special tokens first, so each is encoded by itself.
    """
    t = _tokenizer(path)
    special = next(((i, x.content) for i, x in sorted(t.get_added_tokens_decoder().items()) if x.special and not (x.lstrip or x.rstrip or x.normalized)), None)
    out: list[bytes] = [b""] * len(segments)
    texts = [x.decode() for x in segments]
    alone = [i for i, x in enumerate(texts) if special is None or special[1] in x]
    for i, e in zip(alone, t.encode_batch_fast([texts[i] for i in alone], add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<i4").tobytes()
    apart = set(alone)
    joint = [i for i in range(len(texts)) if i not in apart]
    groups = [joint[i : i + TOGETHER] for i in range(0, len(joint), TOGETHER)]
    for at in range(0, len(groups), 100):
        for group, e in zip(groups[at : at + 100], t.encode_batch_fast([special[1].join([texts[i] for i in g]) for g in groups[at : at + 100]], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<i4")
            cut = np.flatnonzero(ids == special[0])
            raw = ids.tobytes()
            for i, s, f in zip(group, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)], strict=True):
                out[i] = raw[4 * s : 4 * f]
    return out


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the number of each text's ids."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    n = np.zeros(len(texts), np.int64)
    if len(texts) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.int64), n
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    # a segment starts at white space after a byte that is surely no white space: printable ASCII or a letter U+00C0-U+00FF
    solid = (data >= 33) & (data <= 126)
    solid[1:] |= (data[1:] >= 128) & (data[:-1] == 0xC3)
    start = np.zeros(len(data) + 1, bool)
    start[1:-1] = blank[1:] & solid[:-1]
    if not any(pc.any(pc.match_substring(texts, x)).as_py() for x in _special(path)):
        # letters and marks part wherever they meet, but for apostrophes; only special tokens run across
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        mark = (data > 32) & (data < 127) & ~letter & ~((data >= 48) & (data <= 57)) & (data != 39)
        start[1:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    at = np.append(np.flatnonzero(start[:-1]), len(data))
    segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
    coded = segments.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    known = _known(path)
    distinct = coded.dictionary.to_pylist()
    found = [known.get(x) for x in distinct]
    new = [i for i, x in enumerate(found) if x is None]
    for i, ids in zip(new, _encode_segments([distinct[i] for i in new], path), strict=True):
        found[i] = ids
        if len(known) < REMEMBERED:
            known[distinct[i]] = ids
    lens = np.fromiter(map(len, found), np.int32, len(found)) // 4
    flat = np.frombuffer(b"".join(found), "<i4")
    del distinct, found
    first = np.cumsum(lens, dtype=np.int32) - lens
    own = lens[codes]
    ends = np.cumsum(own, dtype=np.int32)
    ids = flat[np.repeat(first[codes] - (ends - own), own) + np.arange(ends[-1], dtype=np.int32)]
    bounds = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
    return ids, np.diff(bounds)


def pack_planes(ids: np.ndarray) -> tuple[int, list[bytes]]:
    """Number of planes, and each plane compressed: plane b has bit b of every id."""
    ids = np.ascontiguousarray(ids, np.uint32)
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    return width, [squeeze(np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes()) for b in range(width)]


def unpack_planes(planes: list[bytes], n: int, start: int = 0, end: int | None = None) -> np.ndarray:
    """Ids start..end of a chunk of n; planes are read as a whole, bits only where they are wanted."""
    end = n if end is None else end
    low, high = start // 8, -(-end // 8)
    out = np.zeros(8 * (high - low), np.uint32)
    spread = zstandard.ZstdDecompressor().decompress
    for b, plane in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(spread(plane), np.uint8)[low:high]).astype(np.uint32) << np.uint32(b)
    return out[start - 8 * low : end - 8 * low]


STORE = "shard int, chunk int, first bigint, n_ids int, doc_ids array<{0}>, doc_starts array<bigint>, doc_lens array<bigint>, planes array<binary>"


def write_store(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the store and returns its table, a row per chunk."""
    small_batches(docs)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    dealt = base.repartitionByRange(blocks_for(docs, shard_bytes), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        held, held_n = [], 0
        queue: list[tuple] = []  # documents whose chunk is not written: id, start in shard, ids
        first, number, total = 0, 0, 0

        def row(ids):
            nonlocal queue, first, number
            width, planes = pack_planes(ids)
            mine = [q for q in queue if q[1] < first + len(ids)]
            queue = queue[len(mine) :]
            cols = [[shard], [number], [first], [len(ids)], [[q[0] for q in mine]], [[q[1] for q in mine]], [[q[2] for q in mine]], [planes]]
            first, number = first + len(ids), number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        schema = None
        for b in (part for batch in batches for part in slices(batch, 1, SLICE)):
            if schema is None:
                schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("doc_ids", pa.list_(b.schema.field(0).type)), ("doc_starts", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary()))])
            ids, n = encode_texts(b.column(1), path)
            ended = np.full(len(ids) + len(n), end_id, np.int32)
            ends = np.cumsum(n + 1) - 1
            keep = np.ones(len(ended), bool)
            keep[ends] = False
            ended[keep] = ids
            starts = total + ends - n
            queue += zip(b.column(0).to_pylist(), starts.tolist(), (n + 1).tolist(), strict=True)
            total += len(ended)
            held.append(ended)
            held_n += len(ended)
            if held_n >= chunk:
                joined = np.concatenate(held)
                for i in range(0, held_n - chunk + 1, chunk):
                    yield row(joined[i : i + chunk])
                held = [joined[held_n - held_n % chunk :]] if held_n % chunk else []
                held_n %= chunk
        if held_n:
            yield row(np.concatenate(held))

    return staged(dealt.mapInArrow(run, STORE.format(kind)), "token-store")


def read_documents(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (array<int>) of every document, from the store alone.

    ``start`` counts the ids of all documents before. A chunk gives the parts of
    documents that lie in it; only documents over a chunk's edge are put together
    by a shuffle.
    """
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()
    totals = store.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("before"))

    names = ["shard", "chunk", "doc_id", "start", "n_tokens", "at", "ids"]

    def whole_documents(batches):
        for b in batches:
            for r in b.to_pylist():
                first, n = r["first"], r["n_ids"]
                starts, lens = np.array(r["doc_starts"], np.int64), np.array(r["doc_lens"], np.int64)
                inside = int(np.searchsorted(starts + lens, first + n, "right"))
                if not inside:
                    continue
                low = int(starts[0]) - first
                ids = unpack_planes(r["planes"], n, low, int(starts[inside - 1] + lens[inside - 1]) - first)
                bounds = np.concatenate([[0], np.cumsum(lens[:inside])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["shard"]] * inside, pa.int32()), pa.array(r["doc_ids"][:inside], b.schema.field("doc_ids").type.value_type), pa.array(starts[:inside]), pa.array(lens[:inside]), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))],
                    names=["shard", "doc_id", "start", "n_tokens", "ids"],
                )

    def edge_parts(batches):
        """What a chunk has of documents that go over its edges: at most one before, and one after."""
        for b in batches:
            out = []
            for r in b.to_pylist():
                first, n, starts, lens = r["first"], r["n_ids"], r["doc_starts"], r["doc_lens"]
                if (lead := min(n, starts[0] - first if starts else n)) > 0:
                    out.append((r["shard"], r["chunk"], None, None, None, first, unpack_planes(r["planes"], n, 0, lead).astype(np.int32)))
                if starts and starts[-1] + lens[-1] > first + n:
                    out.append((r["shard"], r["chunk"], r["doc_ids"][-1], starts[-1], lens[-1], starts[-1], unpack_planes(r["planes"], n, starts[-1] - first, n).astype(np.int32)))
            kinds = [pa.int32(), pa.int32(), b.schema.field("doc_ids").type.value_type, pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)

    whole = store.mapInArrow(whole_documents, f"shard int, doc_id {kind}, start bigint, n_tokens bigint, ids array<int>")
    # a document over an edge: a part without a start belongs to the last one that starts before
    edge = store.mapInArrow(edge_parts, f"shard int, chunk int, doc_id {kind}, start bigint, n_tokens bigint, at bigint, ids array<int>")
    heads = store.select("shard", "first", F.try_element_at("doc_starts", F.lit(-1)).alias("last"))
    carried = heads.select("shard", "first", F.last("last", ignorenulls=True).over(Window.partitionBy("shard").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)).alias("open"))
    edge = edge.join(carried, (edge["shard"] == carried["shard"]) & (edge["at"] == carried["first"]), "left").select(edge["shard"], "doc_id", F.coalesce("start", "open").alias("start"), "n_tokens", "at", "ids")
    joined = edge.groupBy("shard", "start").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
    every = whole.unionByName(joined.select("shard", "doc_id", "start", "n_tokens", "ids"))
    return every.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")
