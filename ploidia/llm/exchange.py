"""Items of many blocks meet by hash, are answered once, and the answers go back.

A block sends its items (words, minimizers, stretches) in messages by a digit of
the items' hash, so one message holds many items. Up to ``radix`` blocks meet in
a node directly. More blocks meet level by level: a node merges what ``radix``
blocks sent it under one digit, equal items becoming one, and sends its items on
by the next digit; after so many levels that all blocks have come together, each
item of the corpus stands in one node, is answered there, and answers retrace the
way. A level sends at most ``radix`` messages a block, whatever the number of
blocks, and no node holds more than about a block's items, or, where items are
merged, fewer. No group grows with the corpus and no item, however frequent,
gathers in one place more than once a node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import from_payload, tidy, to_payload

#: Messages that a block or node sends at most.
RADIX = 256

ASKED = "path bigint, grp bigint, from_path bigint, from_grp bigint, items binary"
ANSWERED = "to_path bigint, to_grp bigint, path bigint, found binary"
#: Where a node's own remarks go (``answer`` may return some), beside the answers.
REMARKS = -1

Rows = list[tuple]


def _table(rows: Rows, schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, pa.int64() if kind == "bigint" else pa.binary()) for c, (_, kind) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _joined(tables: Iterable[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).combine_chunks()


class Meeting:
    """How items of ``n_blocks`` blocks meet.

    key:    table of items -> a hash of each item's identity (uint64)
    merge:  list of tables -> (table of distinct items, place of each table's items in it)
    answer: table of distinct items -> table of answers, row by row, or (that, remarks as bytes)
    """

    def __init__(self, n_blocks: int, key: Callable, merge: Callable, answer: Callable, pack: Callable = to_payload, unpack: Callable = from_payload, radix: int = RADIX):
        self.levels = 1
        while radix**self.levels < n_blocks:
            self.levels += 1
        self.radix = next(r for r in range(1, radix + 1) if r**self.levels >= n_blocks)
        self.key, self.merge, self.answer, self.pack, self.unpack = key, merge, answer, pack, unpack

    def _order(self, items: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows by digit, digits, where each digit's rows start) for what a node of ``level`` sends."""
        digit = (self.key(items) // np.uint64(self.radix**level) % np.uint64(self.radix)).astype(np.uint16)
        rows = np.argsort(digit, kind="stable")
        digits, starts = np.unique(digit[rows], return_index=True)
        return rows, digits, np.append(starts, len(rows))

    def _sent(self, items: pa.Table, level: int, path: int, grp: int) -> Rows:
        rows, digits, starts = self._order(items, level)
        dealt = items.take(pa.array(rows))
        return [(path * self.radix + d, grp // self.radix, path, grp, self.pack(dealt.slice(s, e - s))) for d, s, e in zip(digits.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)]

    def ask(self, items: pa.Table, block: int) -> pa.Table:
        """A block's messages; schema ASKED."""
        return _table(self._sent(items, 0, 0, block), ASKED)

    def told(self, items: pa.Table, found: pa.Table, level: int = 0) -> pa.Table | None:
        """Answers to ``items``, row by row, from the rows (ANSWERED) that came back."""
        if items.num_rows == 0:
            return None
        rows, _, _ = self._order(items, level)
        back = np.empty(len(rows), np.int64)
        back[rows] = np.arange(len(rows))
        return _joined(from_payload(x.as_buffer()) for x in found.sort_by("path").column("found")).take(pa.array(back))

    def _met(self, group: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        return self.merge([self.unpack(x.as_buffer()) for x in group.column("items")])

    @staticmethod
    def _returned(group: pa.Table, answers: pa.Table, places: list[np.ndarray]) -> Rows:
        senders = zip(*(group.column(c).to_pylist() for c in ("from_path", "from_grp", "path")), places, strict=True)
        return [(p, g, path, to_payload(answers.take(pa.array(own)))) for p, g, path, own in senders]

    def meet(self, asked: DataFrame) -> DataFrame:
        """Rows of schema ANSWERED for the messages of all blocks (``ask``): to_path 0, to_grp the block; and remarks, to_path REMARKS."""

        def final(group: pa.Table) -> pa.Table:
            tidy()
            items, places = self._met(group)
            answers = self.answer(items)
            answers, remarks = answers if isinstance(answers, tuple) else (answers, None)
            rows = self._returned(group, answers, places)
            return _table(rows if remarks is None else [*rows, (REMARKS, group.column("path")[0].as_py(), 0, remarks)], ANSWERED)

        def forward(level: int):
            def run(group: pa.Table) -> pa.Table:
                tidy()
                return _table(self._sent(self._met(group)[0], level, group.column("path")[0].as_py(), group.column("grp")[0].as_py()), ASKED)

            return run

        def back(level: int):
            def run(group: pa.Table, found: pa.Table) -> pa.Table:
                tidy()
                if not group.num_rows:  # remarks pass through
                    return found.select(["to_path", "to_grp", "path", "found"])
                items, places = self._met(group)
                return _table(self._returned(group, self.told(items, found, level), places), ANSWERED)

            return run

        steps = [asked]
        for level in range(1, self.levels):
            steps.append(steps[-1].groupBy("path", "grp").applyInArrow(forward(level), ASKED))
        out = steps[-1].groupBy("path", "grp").applyInArrow(final, ANSWERED)
        for level in range(self.levels - 1, 0, -1):
            out = steps[level - 1].groupBy("path", "grp").cogroup(out.groupBy("to_path", "to_grp")).applyInArrow(back(level), ANSWERED)
        return out


def word_key(column: str = "w") -> Callable:
    return lambda items: word_hashes(items.column(column))


with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(words) -> np.ndarray:
    """A hash of each (non-empty) word's bytes."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
        words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]]
    start = at[:-1] - at[0]
    place = np.arange(len(data)) - np.repeat(start, np.diff(at))
    with np.errstate(over="ignore"):
        h = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63], start)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def flat_column(table: pa.Table, name: str) -> pa.Array:
    """A column as one array."""
    c = table.column(name).combine_chunks()
    return pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
