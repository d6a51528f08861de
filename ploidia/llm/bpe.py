"""BPE encoding and decoding through a table of distinct words.

Documents gather in blocks by hash. A block's texts are split at ASCII white
space, and only its distinct words leave it; where they meet (see ``exchange``),
each distinct word is encoded once. The ids come back per block and are joined to
the words by position. Decoding joins each id to its piece: the vocabulary, whose
size the tokenizer fixes, stands in every task in the order of its ids, so the
join is by index, a batch of documents at a time, without a shuffle.

The tokenizer must drop white space and treat every word by itself (NFC, lower
case, split into letters, digits and the rest, as word-level vocabularies do);
then the ids of a text are those of its words, one after another. A hot word
counts once per block, whatever its frequency.

Defined results: null counts as empty, and an empty text has no ids and decodes
to the empty text; special tokens' strings inside a text are recognised as the
library does by default; repeated rows and null ids each return a row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ASKED, RADIX, Meeting, flat_column, word_key
from .shared import blocks_for, packed_blocks, unpacked

#: Input bytes (as stored) that make one block; a block is handled in memory.
BLOCK_BYTES = 7 << 20
#: Words given to the library at once.
BATCH = 10_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


@lru_cache(maxsize=4)
def _pieces(path: str) -> pa.Array:
    """Piece by id."""
    vocab = _tokenizer(path).get_vocab(with_added_tokens=True)
    out: list[str | None] = [None] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return pa.array(out, pa.large_string())


def _split(texts) -> pa.ListArray:
    """Words of each text; runs of white space at either end leave no empty word."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, parent = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    n = np.bincount(parent[full], minlength=len(lists)) if len(parent) else np.zeros(len(lists), np.int64)
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int64), flat.filter(pa.array(full)))


def _distinct(lists) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the distinct words in byte order."""
    coded = lists.values.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes] if len(codes) else np.zeros(0, np.int64), words.take(pa.array(order))


def merged_words(tables: list[pa.Table]) -> tuple[pa.Table, list[np.ndarray]]:
    """Distinct words (column w) of tables, in byte order, and the place of each table's words."""
    coded = pa.concat_arrays([c for t in tables for c in t.column("w").chunks]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)]
    ends = np.cumsum([0] + [t.num_rows for t in tables])
    return pa.table({"w": coded.dictionary.take(pa.array(order))}), [codes[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]


def _encode_words(words: pa.Array, path: str) -> pa.ListArray:
    t = _tokenizer(path)
    offsets, ids = [np.zeros(1, np.int64)], []
    for at in range(0, len(words), BATCH):
        got = [e.ids for e in t.encode_batch_fast(words[at : at + BATCH].to_pylist(), add_special_tokens=False)]
        offsets.append(np.fromiter(map(len, got), np.int64, len(got)))
        ids.append(np.fromiter((i for x in got for i in x), np.int32))
    return pa.LargeListArray.from_arrays(np.cumsum(np.concatenate(offsets)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, radix: int = RADIX) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>)."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    n = blocks_for(docs, block_bytes)
    blocks = packed_blocks(base, n, "doc_id", "text")
    meeting = Meeting(n, word_key(), merged_words, lambda items: pa.table({"ids": _encode_words(flat_column(items, "w"), path)}), radix=radix)

    def words_of_block(group: pa.Table) -> pa.Table:
        return meeting.ask(pa.table({"w": _distinct(_split(unpacked(group).column("text")))[1]}), group.column("block")[0].as_py())

    def join_by_position(group: pa.Table, answers: pa.Table) -> pa.Table:
        rows = unpacked(group)
        lists = _split(rows.column("text"))
        codes, words = _distinct(lists)
        told = meeting.told(pa.table({"w": words}), answers)
        ids = pa.LargeListArray.from_arrays(np.zeros(1, np.int64), pa.array([], pa.int32())) if told is None else flat_column(told, "ids")
        n_ids = pc.list_value_length(ids).to_numpy() if len(ids) else np.zeros(0, np.int64)
        starts = lists.offsets.to_numpy()
        out = []
        # a few documents at a time, so that the expanded ids stay small
        size = np.concatenate([[0], np.cumsum(n_ids[codes])])
        step = max(1, len(starts) // max(1, int(size[-1] // 500_000)))
        for a in range(0, len(starts) - 1, step):
            b = min(a + step, len(starts) - 1)
            flat = ids.take(pa.array(codes[starts[a] : starts[b]])).flatten().cast(pa.int32())
            bounds = size[starts[a : b + 1]] - size[starts[a]]
            out.append(pa.table({"doc_id": rows.column("doc_id")[a:b], "n_tokens": pa.array(np.diff(bounds).astype(np.int64)), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)}))
        return pa.concat_tables(out)

    answered = meeting.meet(blocks.groupBy("block").applyInArrow(words_of_block, ASKED))
    return blocks.groupBy("block").cogroup(answered.groupBy("to_grp")).applyInArrow(join_by_position, f"doc_id {kind}, n_tokens bigint, ids array<int>")


def decode_ids(ids: pa.Array, path: str) -> pa.Array:
    """Text of each list of ids: its pieces with one blank between, as the library decodes without a decoder."""
    pieces = _pieces(path).take(ids.values)
    return pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), pieces), pa.scalar(" ", pa.large_string()))


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded``: ids joined to the vocabulary's pieces by index; null ids decode to the empty text."""

    @F.arrow_udf("string")
    def joined(ids: pa.Array) -> pa.Array:
        at = ids.offsets.to_numpy()
        # a few documents at a time, so that their pieces stay small
        cuts = [0, *np.flatnonzero(np.diff(at[:-1] // 500_000)) + 1, len(ids)]
        parts = [decode_ids(ids.slice(a, b - a), path).cast(pa.string()) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    wanted = F.coalesce(F.col(f"`{ids_col}`").cast("array<int>"), F.array().cast("array<int>"))
    return encoded.withColumn("decoded", joined(wanted))
