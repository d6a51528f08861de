"""Language-model scoring with a small causal self-attention model, in numpy.

Words are lower-cased (A-Z) and split into subword ids; a text's ids are those
of its words and one end id. A subword belongs to a class, and

    P(id | before) = P(class | context) * P(id | class, context)

a softmax over the ids in two steps. Both come from a block of causal
self-attention on subword ids: embeddings of ids and places, masked attention with
its residual, a normalised feed-forward layer with its residual, and out of that the
scores of the classes and of the ids within them. Ids beyond the ``OWN`` most frequent
have a score by bands of like frequency. Scores start at counts over every training
document: each distinct word of the corpus is counted and encoded once, where its
copies meet; class scores start at the corpus's class transitions, those of an id that
begins a word at its class's counts, of one that goes on at counts after the very id
before it where both are among the ``OWN`` most frequent, and after that id's class
otherwise. The block trains on every id of every training document, in rounds of a
share of the documents each: in every partition by steps from common weights, whose
means are taken after the round. What it learns from grows with the corpus, and only
tables of fixed size reach the driver or the tasks.

Texts longer than a window are scored in windows that overlap: the first ids of
a window are context only, so each id is scored once, and masks keep ids from
seeing what follows. Windows of many documents make one batch.

The base score is that of single words with add-0.1 smoothing, from the same
word table.

Defined results: null counts as empty, which still has its end; a null id is
taken as the text "null" for the fold; no training document leaves uniform
classes and ids; repeated rows and ids each return a row; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BLOCK_BYTES, _split
from .exchange import ASKED, RADIX, REMARKS, Meeting, flat_column, word_hashes, word_key
from .shared import ascii_lower, blocks_for, from_payload, packed_blocks, slices, staged, to_payload, unpacked

#: Window, of which the first OVERLAP ids are context only.
WINDOW, OVERLAP = 16, 2
WIDTH = 8
#: Classes of ids that begin a word, and of those that go on; of each, so many hold one frequent id alone.
BEGIN, GO_ON = 16, 32
BEGIN_ALONE, GO_ON_ALONE = 8, 16
CLASSES = BEGIN + GO_ON
#: Ids with an embedding of their own; others share that of their class.
OWN = 1024
#: Places of the feed-forward layer.
INNER = 2 * WIDTH
#: Bands by frequency of the ids that begin a word and have no embedding of their own, and of those that go on.
BANDS = 16
#: Rounds in which the training documents are gone through once, and windows of a step.
ROUNDS, BATCH = 3, 256
#: Bytes of ids (two each) laid out at once.
IDS_BYTES = 1 << 20


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# ---- ids and word counts ---------------------------------------------------------------------------------------------


def _coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of each word, and the distinct words in an order that they alone decide: by hash, or by bytes if two hashes are equal."""
    coded = words.dictionary_encode()
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    hashes = word_hashes(words)
    order = np.argsort(hashes)
    if not np.diff(hashes.take(order)).all():
        order = pc.sort_indices(words).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank.take(codes) if len(codes) else np.zeros(0, np.int64), words.take(pa.array(order))


def tokenised(docs: DataFrame, path: str, pattern: str, end_id: int, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, radix: int = RADIX):
    """(documents, stats): per document its ids and base sums; per part the counts of words, ids and pairs of ids.

    documents: doc_id, held_out, n_tokens, n_known, known_sum (sum of log10(count + 0.1)), ids (uint16, little-endian)
    stats:     kind, a, b, n - kind 0: id a stands n times; 1: id b follows a in a word; 2: a ends a word; 3: totals (a: words, b: distinct)
    """
    if _encoding(path, pattern).max_token_value >= 1 << 16 or end_id >= 1 << 16:
        raise ValueError("ids of 16 bits are wanted")
    base = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text"),
        (F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).cast("binary")), F.lit(10)) == 0).alias("held_out"),
    )
    kind = base.schema["doc_id"].dataType.simpleString()
    n = blocks_for(docs, block_bytes)
    blocks = staged(packed_blocks(base, n, "doc_id", "text"), "lm-blocks")  # read twice

    def words_of(group: pa.Table):
        """(rows of a block, its lists of words, code of each word, table of distinct words and their counts in training)."""
        rows = unpacked(group)
        lists = _split(rows.column("text"))
        codes, words = _coded(lists.values)
        trained = np.repeat(~rows.column("held_out").to_numpy(), np.diff(lists.offsets.to_numpy()))
        return rows, lists, codes, pa.table({"w": words, "n": np.bincount(codes[trained], minlength=len(words)).astype(np.int64)})

    def merge(tables: list[pa.Table]):
        codes, words = _coded(pa.concat_arrays([c for t in tables for c in t.column("w").chunks]))
        count = np.bincount(codes, weights=np.concatenate([t.column("n").to_numpy() for t in tables]), minlength=len(words))
        return pa.table({"w": words, "n": pa.array(count.astype(np.int64))}), np.split(codes, np.cumsum([t.num_rows for t in tables])[:-1])

    def answer(items: pa.Table):
        """Ids of each word; and this node's counts, weighted by the words'."""
        count = items.column("n").to_numpy()
        encode = _encoding(path, pattern).encode_ordinary
        got = [encode(" " + w) for w in items.column("w").to_pylist()]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((i for x in got for i in x), np.int32, int(lens.sum()))
        ids = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lens)]), pa.array(flat))
        weight = np.repeat(count, lens)
        one = np.bincount(flat, weights=weight, minlength=1 << 16)
        last = np.cumsum(lens)[lens > 0] - 1
        first = np.zeros(len(flat), bool)
        first[(np.cumsum(lens) - lens)[lens > 0]] = True
        go = np.flatnonzero(~first)
        pair, where = np.unique(flat[go - 1].astype(np.int64) << 16 | flat[go], return_inverse=True)
        pair_n = np.bincount(where, weights=weight[go], minlength=len(pair))
        final = np.bincount(flat[last], weights=count[lens > 0], minlength=1 << 16)
        rows = [
            np.stack([np.zeros(x := np.count_nonzero(one), np.int64), np.flatnonzero(one), np.zeros(x, np.int64), one[one > 0].astype(np.int64)]),
            np.stack([np.ones(len(pair), np.int64), pair >> 16, pair & 0xFFFF, pair_n.astype(np.int64)])[:, pair_n > 0],
            np.stack([np.full(x := np.count_nonzero(final), 2), np.flatnonzero(final), np.zeros(x, np.int64), final[final > 0].astype(np.int64)]),
            np.array([[3], [int(count.sum())], [int((count > 0).sum())], [0]]),
        ]
        stats = to_payload(pa.table(dict(zip(("kind", "a", "b", "n"), np.concatenate(rows, 1), strict=True))))
        return pa.table({"ids": ids, "n": items.column("n")}), stats

    meeting = Meeting(n, word_key(), merge, answer, radix=radix)

    def words_of_block(group: pa.Table) -> pa.Table:
        return meeting.ask(words_of(group)[3], group.column("block")[0].as_py())

    def ids_of_documents(group: pa.Table, found: pa.Table) -> pa.Table:
        rows, lists, codes, words = words_of(group)
        told = meeting.told(words, found)
        ids = pa.LargeListArray.from_arrays(np.zeros(1, np.int64), pa.array([], pa.int32())) if told is None else flat_column(told, "ids")
        count = np.zeros(0, np.int64) if told is None else told.column("n").to_numpy()
        starts = lists.offsets.to_numpy()
        lens = pc.list_value_length(ids).to_numpy() if len(ids) else np.zeros(0, np.int64)
        own = np.concatenate([[0], np.cumsum(lens.take(codes))])[starts]
        known = np.concatenate([[0], np.cumsum((count > 0).take(codes))])[starts]
        logs = np.concatenate([[0.0], np.cumsum(np.log10(count + 0.1).take(codes))])[starts]
        out, texts = [], len(starts) - 1
        step = max(1, texts // max(1, int(own[-1] // 2_000_000)))
        for a in range(0, texts, step):
            b = min(a + step, texts)
            flat = ids.take(pa.array(codes[starts[a] : starts[b]])).flatten().to_numpy().astype("<u2")
            cut = own[a : b + 1] - own[a]
            out += [flat[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)]
        end = np.array([end_id], "<u2").tobytes()
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_words": pa.array(np.diff(starts).astype(np.int64)), "n_known": pa.array(np.diff(known).astype(np.int64)), "known_sum": pa.array(np.diff(logs)), "ids": pa.array([x + end for x in out], pa.binary())})

    found = staged(meeting.meet(blocks.groupBy("block").applyInArrow(words_of_block, ASKED)), "lm-words")

    def spread(batches):
        for b in batches:
            for x in b.column(0):
                yield from from_payload(x.as_buffer()).to_batches()

    stats = staged(found.where(F.col("to_path") == REMARKS).select("found").mapInArrow(spread, "kind bigint, a bigint, b bigint, n bigint").withColumn("w", F.when(F.col("kind") == 3, F.col("a")).otherwise(0)).groupBy(F.col("kind"), F.when(F.col("kind") == 3, 0).otherwise(F.col("a")).alias("a"), F.when(F.col("kind") == 3, 0).otherwise(F.col("b")).alias("b")).agg(F.sum("n").alias("n"), F.sum("w").alias("words"), F.sum(F.when(F.col("kind") == 3, F.col("b")).otherwise(0)).alias("distinct")), "lm-stats")
    documents = staged(blocks.groupBy("block").cogroup(found.where("to_path >= 0").groupBy("to_grp")).applyInArrow(ids_of_documents, f"doc_id {kind}, held_out boolean, n_words bigint, n_known bigint, known_sum double, ids binary"), "lm-documents")
    return documents, stats


# ---- classes and counts ----------------------------------------------------------------------------------------------


@dataclass
class Classes:
    of: np.ndarray  # class of each id
    slot: np.ndarray  # embedding row of each id
    within: np.ndarray  # log P(id | class, class before) as [class before or CLASSES for a word's start, id]
    pair: np.ndarray  # the same for an id that goes on, as [id before, id], by embedding row, where both have their own
    start: np.ndarray  # log P(class | embedding row before), the layer's starting point
    row: np.ndarray | None = None  # row of each id's score within its class; ids of one row keep the counts' shares

    def __post_init__(self):
        self.row = self.slot if self.row is None else self.row


class Members:
    """Of each class of several rows: the rows, and the log of their share by the embedding row before; ``place``: where a row stands among its class's.

    These classes are numbered as they come (``order``; all others share the number
    after the last), and their rows stand one class after the other in ``all``.
    """

    def __init__(self, c: Classes):
        self.row, self.rows, self.log, self.place = c.row, {}, {}, np.zeros(OWN + CLASSES + 2 * BANDS, np.int64)
        before = np.arange(OWN + CLASSES) - OWN  # class of each embedding row
        own = c.slot < OWN
        before[c.slot[own]] = c.of[own]
        before[before < 0] = 0  # rows of no id
        for k in np.unique(c.of):
            ids = np.flatnonzero(c.of == k)
            rows, which = np.unique(c.row[ids], return_inverse=True)
            if len(rows) == 1:
                continue
            share = np.zeros((len(c.within), len(rows)), np.float64)
            np.add.at(share.T, which, np.exp(c.within[:, ids], dtype=np.float64).T)
            log = np.log(share).astype(np.float32)
            if k < BEGIN:
                log = log[CLASSES:]
            else:
                log = log[before]
                if rows[-1] < OWN:
                    log[:OWN] = c.pair[:, rows]
            self.rows[int(k)], self.log[int(k)], self.place[rows] = rows, np.ascontiguousarray(log), np.arange(len(rows))
        self.order = np.full(CLASSES, len(self.rows), np.int8)
        self.order[list(self.rows)] = np.arange(len(self.rows))
        self.width = np.array([*map(len, self.rows.values()), 0], np.int64)
        self.all = np.concatenate([np.zeros(0, np.int64), *self.rows.values()])
        self.spans = [slice(e - n, e) for n, e in zip(self.width.tolist(), np.cumsum(self.width).tolist(), strict=True)]

    def groups(self, y: np.ndarray):
        """Places of y by class, those of the classes of several rows first, with their number; and (class, run of these places, its span in ``all``)."""
        key = self.order.take(y)
        n = np.bincount(key, minlength=len(self.spans)).tolist()
        runs, at = [], 0
        for k, size, span in zip(self.rows, n, self.spans, strict=False):
            if size:
                runs.append((k, slice(at, at + size), span))
                at += size
        return key.argsort(kind="stable"), at, runs

    def odds(self, groups, h: np.ndarray, x: np.ndarray, u: np.ndarray):
        """What each row of the class stands for after states h and embedding rows x, before it is made to sum to one; all in a row,
        and as one matrix a run of ``groups``. ``u``: the scores of ``all``."""
        size = sum((i.stop - i.start) * (n.stop - n.start) for _, i, n in groups)
        z, log, parts, at = np.empty(size, h.dtype), np.empty(size, np.float32), [], 0
        for k, i, n in groups:
            shape = i.stop - i.start, n.stop - n.start
            end = at + shape[0] * shape[1]
            part, to = z[at:end].reshape(shape), log[at:end].reshape(shape)
            np.matmul(h[i], u[n].T, out=part)
            if k < BEGIN:
                to[:] = self.log[k]
            else:
                self.log[k].take(x[i], 0, to, "clip")
            parts.append(part)
            at = end
        z += log
        return np.exp(z, out=z), parts


def _k_means(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return np.arange(len(x))
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    mid = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        own = (x @ mid.T).argmax(1)
        mid = np.stack([x[own == j].mean(0) if (own == j).any() else x[rng.integers(len(x))] for j in range(k)])
        mid /= np.maximum(np.linalg.norm(mid, axis=1, keepdims=True), 1e-9)
    return (x @ mid.T).argmax(1)


def classes_of(stats: DataFrame, begins: np.ndarray, end_id: int, n_docs: int) -> Classes:
    """Classes of ids by what stands next to them within words, and smoothed counts. Tables of fixed size only."""
    size = len(begins)
    one = np.zeros(size)
    last = np.zeros(size)
    for kind, a, n in stats.where("kind in (0, 2)").select("kind", "a", "n").toArrow().to_pandas().itertuples(index=False):  # at most two rows an id
        (one if kind == 0 else last)[a] = n
    one[end_id] = last[end_id] = n_docs
    top = np.argsort(-one, kind="stable")[:OWN]
    top = top[one[top] > 0]
    place = np.full(size, -1)
    place[top] = np.arange(len(top))
    spark = stats.sparkSession
    names = spark.createDataFrame([(int(i),) for i in top], "id bigint")
    # pairs among the OWN most frequent ids
    pairs = stats.where("kind = 1").join(F.broadcast(names.withColumnRenamed("id", "a")), "a").join(F.broadcast(names.withColumnRenamed("id", "b")), "b").select("a", "b", "n").toArrow()
    m = np.zeros((len(top), len(top)), np.float32)
    m[place[pairs.column("a").to_numpy()], place[pairs.column("b").to_numpy()]] = pairs.column("n").to_numpy()
    shape = np.log1p(np.concatenate([m, m.T], 1), dtype=np.float32)
    of = np.where(begins, BEGIN - 1, CLASSES - 1)
    for wanted, at, alone, k in ((True, 0, BEGIN_ALONE, BEGIN), (False, BEGIN, GO_ON_ALONE, GO_ON)):
        mine = top[begins[top] == wanted]
        of[mine[:alone]] = at + np.arange(len(mine[:alone]))
        rest = mine[alone:]
        if len(rest):
            of[rest] = at + alone + _k_means(shape[place[rest]], k - alone - 1)
    of[end_id] = BEGIN - 2 if of[end_id] >= BEGIN_ALONE else of[end_id]
    slot = np.where(place >= 0, place, OWN + of)

    # counts by class before, over all pairs: CLASSES x ids at most
    own = spark.createDataFrame([(i, int(c)) for i, c in enumerate(of)], "a bigint, c int")
    by = stats.where("kind = 1").join(F.broadcast(own), "a").groupBy("c", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((CLASSES + 1, size), np.float32)
    np.add.at(table, (by.column("c").to_numpy(), by.column("b").to_numpy()), by.column("n").to_numpy())
    table[CLASSES] = one
    members = np.bincount(of, minlength=CLASSES)
    total = np.bincount(of, weights=one, minlength=CLASSES)
    plain = (one + 0.05) / (total + 0.05 * members)[of]
    within = np.empty((CLASSES + 1, size), np.float32)
    for c in range(CLASSES + 1):
        sums = np.bincount(of, weights=table[c], minlength=CLASSES)
        within[c] = np.log((table[c] + 2.0 * plain) / (sums[of] + 2.0))
    within[CLASSES] = np.log(plain)

    # by the very id before, where both are frequent: OWN x OWN, drawn towards the class's table
    pair = np.full((OWN, OWN), -40.0, np.float32)
    k = len(top)
    share = np.zeros((k, k), np.float32)
    for c in range(BEGIN, CLASSES):
        mine = of[top] == c
        share[:, mine] = m[:, mine].sum(1, keepdims=True)
    pair[:k, :k] = np.log((m + 4.0 * np.exp(within[of[top]][:, top])) / (share + 4.0))

    begin_mass = np.bincount(of[begins], weights=one[begins], minlength=CLASSES) + 0.5 * (np.arange(CLASSES) < BEGIN)
    begin_mass /= begin_mass.sum()
    rows = OWN + CLASSES
    go = np.zeros((rows, CLASSES))
    on = stats.where("kind = 1").join(F.broadcast(own.select(F.col("a").alias("b"), "c")), "b").join(F.broadcast(spark.createDataFrame([(i, int(s)) for i, s in enumerate(slot)], "a bigint, s int")), "a").groupBy("s", "c").agg(F.sum("n").alias("n")).toArrow()
    np.add.at(go, (on.column("s").to_numpy(), on.column("c").to_numpy()), on.column("n").to_numpy())
    ends = np.bincount(slot, weights=last, minlength=rows)
    go += ends[:, None] * begin_mass[None, :]
    overall = go.sum(0) + 1e-3
    go += 5.0 * overall / overall.sum()
    # the other ids in bands of like frequency and equal weight
    row = slot.copy()
    for i, wanted in enumerate((True, False)):
        rest = np.flatnonzero((slot >= OWN) & (begins == wanted) & (np.arange(size) != end_id))
        rest = rest[np.argsort(-one[rest], kind="stable")]
        mass = np.cumsum(one[rest] + 0.05)
        row[rest] = OWN + CLASSES + BANDS * i + np.minimum(BANDS - 1, (BANDS * mass / mass[-1:]).astype(np.int64))
    return Classes(of.astype(np.int64), slot.astype(np.int64), within, pair, np.log(go / go.sum(1, keepdims=True)).astype(np.float32), row.astype(np.int64))


# ---- the attention layer ---------------------------------------------------------------------------------------------

MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def new_weights(start: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s, by=0.2: (rng.standard_normal(s) * by).astype(np.float32)
    w = {"emb": draw(len(start), WIDTH, by=0.5), "pos": draw(WINDOW, WIDTH, by=0.1), "qkv": draw(WIDTH, 3 * WIDTH), "out": draw(WIDTH, WIDTH), "cls": draw(WIDTH, CLASSES, by=0.02), "bias": start.copy()}
    w["qkv"][:, :WIDTH] *= np.float32(WIDTH**-0.5)
    # the feed-forward layer and the ids' scores start at nothing, so the counts are the starting point
    w |= {"ff_in": draw(WIDTH, INNER, by=WIDTH**-0.5), "ff_bias": np.zeros(INNER, np.float32), "ff_out": np.zeros((INNER, WIDTH), np.float32)}
    w["ids"] = np.zeros((len(start) + 2 * BANDS, WIDTH), np.float32)
    return w


#: Places whose odds of classes are held at once, so that they stay near the processor; and where each one's start.
RUN = 1024
FIRST = np.arange(RUN) * CLASSES

CENTRE = np.eye(WIDTH, dtype=np.float32) - np.float32(1 / WIDTH)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with that of b; [n, 1]."""
    return (a * b) @ np.ones((a.shape[1], 1), a.dtype)


def _turned(m: np.ndarray) -> np.ndarray:
    """Each window's matrix the other way round, laid out anew: products of small matrices are slow with one that is not."""
    return np.ascontiguousarray(m.transpose(0, 2, 1))


def normalised(h: np.ndarray):
    """(n, over): columns less their mean, over their spread; and one over the spread."""
    n = CENTRE.astype(h.dtype, copy=False) @ h
    over = (n * n).sum(0)
    over /= WIDTH
    over += h.dtype.type(1e-5)
    np.sqrt(over, out=over)
    np.divide(1, over, out=over)
    n *= over
    return n, over


def feed_forward(w: dict, h: np.ndarray):
    """(h plus what the layer makes of h, what its backward step needs). Inside, a place is a column: rows of WIDTH are short for numpy's loops."""
    h = np.ascontiguousarray(h.T)
    n, over = normalised(h)
    f = w["ff_in"].T @ n
    f += w["ff_bias"][:, None]
    np.maximum(f, 0, out=f)
    h += w["ff_out"].T @ f
    return np.ascontiguousarray(h.T), (n, over, f)


def attend(qkv: np.ndarray):
    """(a, s, over): what each place of the windows [B, T, 3 WIDTH] draws from places up to itself; masked weights, and one over their sums."""
    t = qkv.shape[1]
    s = qkv[:, :, :WIDTH] @ _turned(qkv[:, :, WIDTH : 2 * WIDTH])
    s += MASK[:t, :t]
    np.exp(s, out=s)  # scores are small: no shift is needed, masked ones vanish
    over = (s.reshape(-1, t) @ np.ones(t, s.dtype)).reshape(-1, t, 1)
    np.divide(1, over, out=over)
    a = s @ qkv[:, :, 2 * WIDTH :]
    a *= over
    return a, s, over


def backward(w: dict, x: np.ndarray, y: np.ndarray, live: np.ndarray, members: Members | None = None, row: np.ndarray | None = None):
    """Mean loss over live places of windows x of embedding rows [B, T], whose next ids are of classes y and rows ``row`` of ``members``
    (left out: of the classes alone), and gradients of all but the counted class transitions (``bias``), which stay as they are.

    Behind the attention, places stand by class. Odds within classes are not made to sum
    to one: their sums go into the rows of states, which are narrower.
    """
    (b, t), n = x.shape, max(1.0, float(live.sum()))
    whole = lambda m: m.reshape(b, t, -1)
    flat = lambda m: m.reshape(b * t, -1)
    rows, kind = x.ravel().astype(np.intp), y.ravel()
    e = whole(w["emb"].take(rows, 0))
    e += w["pos"][:t]
    e = flat(e)
    qkv = whole(e @ w["qkv"])
    a, s, over = attend(qkv)
    mid = flat(a) @ w["out"]
    mid += e
    weight = (live.ravel() / n).astype(mid.dtype)
    after = rows
    if members is not None:
        order, several, groups = members.groups(kind)
        mid, after, kind, weight = mid.take(order, 0), rows.take(order), kind.take(order), weight.take(order)
    h, (norm, spread, f) = feed_forward(w, mid)
    loss, g, dh = 0.0, {"cls": np.zeros_like(w["cls"]), "ids": np.zeros_like(w["ids"])}, np.empty_like(h)
    back_to, ones = np.ascontiguousarray(w["cls"].T), np.ones(CLASSES, h.dtype)
    for i in (slice(at, min(at + RUN, len(h))) for at in range(0, len(h), RUN)):
        z = h[i] @ w["cls"]
        z += w["bias"].take(after[i], 0)
        want = kind[i] + FIRST[: len(z)]
        said = z.take(want)
        np.exp(z, out=z)
        total = z @ ones
        loss += float((np.log(total) - said) @ weight[i])
        z *= (weight[i] / total)[:, None]
        z.reshape(-1)[want] -= weight[i]  # now the gradient
        g["cls"] += h[i].T @ z
        np.matmul(z, back_to, out=dh[i])
    if members is not None and several:
        u = w["ids"].take(members.all, 0)
        q, parts = members.odds(groups, h, after, u)
        width = members.width.take(members.order.take(kind[:several]))
        want = np.cumsum(width)
        want += members.place.take(row.ravel().take(order[:several])) - width
        total = np.empty(several, q.dtype)
        ones = np.ones(max(members.width), q.dtype)
        for (_, i, _), part in zip(groups, parts, strict=True):
            np.matmul(part, ones[: part.shape[1]], out=total[i])
        loss -= float((np.log(q.take(want) / total) * weight[:several]).sum())
        q[want] -= total
        share = (weight[:several] / total)[:, None]
        hs, du, ds = h[:several] * share, np.zeros_like(u), np.empty_like(h[:several])
        for (_, i, m), part in zip(groups, parts, strict=True):
            np.matmul(part.T, hs[i], out=du[m])
            np.matmul(part, u[m], out=ds[i])
        g["ids"][members.all] = du
        ds *= share
        dh[:several] += ds
    dh = np.ascontiguousarray(dh.T)
    g["ff_out"] = f @ dh.T
    df = w["ff_out"] @ dh
    df *= f > 0
    g["ff_bias"], g["ff_in"] = df.sum(1), norm @ df.T
    dn = w["ff_in"] @ df
    along = (dn * norm).sum(0)
    along /= WIDTH
    dn -= norm * along
    dn *= spread
    dh += CENTRE.astype(dn.dtype, copy=False) @ dn
    dh = np.ascontiguousarray(dh.T)
    if members is not None:
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        dh = dh.take(back, 0)
    g["out"] = flat(a).T @ dh
    da = dh @ w["out"].T
    da *= flat(over)
    along = whole(_dots(da, flat(a)))
    da = whole(da)
    dqkv = np.empty_like(qkv)
    np.matmul(s.transpose(0, 2, 1), da, out=dqkv[:, :, 2 * WIDTH :])
    ds = da @ _turned(qkv[:, :, 2 * WIDTH :])
    ds -= along
    ds *= s
    np.matmul(ds, qkv[:, :, WIDTH : 2 * WIDTH], out=dqkv[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), qkv[:, :, :WIDTH], out=dqkv[:, :, WIDTH : 2 * WIDTH])
    dqkv = flat(dqkv)
    g["qkv"] = e.T @ dqkv
    de = dqkv @ w["qkv"].T
    de += dh
    g["pos"] = np.zeros_like(w["pos"])
    g["pos"][:t] = (np.ones(b, de.dtype) @ de.reshape(b, -1)).reshape(t, -1)
    g["emb"] = np.empty_like(w["emb"])
    for i, part in enumerate(np.ascontiguousarray(de.T)):
        g["emb"][:, i] = np.bincount(rows, part, len(w["emb"]))
    return loss, g


class Scorer:
    """The layer for scoring: what depends on an embedding row or a place alone is worked out once, in tables."""

    def __init__(self, w: dict):
        self.w = w
        self.qkv, self.qkv_at = w["emb"] @ w["qkv"], w["pos"] @ w["qkv"]

    def states(self, x: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """The block's output at each place of windows x of embedding rows [B, T], or at those ``wanted`` of them all; [places, WIDTH]."""
        t, w = x.shape[1], self.w
        qkv = self.qkv.take(x, 0)
        qkv += self.qkv_at[:t]
        a, _, _ = attend(qkv)
        e = w["emb"].take(x, 0)
        e += w["pos"][:t]
        e = e.reshape(-1, WIDTH)
        e += a.reshape(-1, WIDTH) @ w["out"]
        return feed_forward(w, e if wanted is None else e.take(wanted, 0))[0]

    def logits(self, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Class scores after embedding rows x and states h, before they are made to sum to one."""
        z = h @ self.w["cls"]
        z += self.w["bias"].take(x, 0)
        return z


class Descent:
    """Adam over windows as they come, each once, in a seeded order within what comes together."""

    def __init__(self, w: dict, rate: float, members: Members, batch: int = BATCH):
        # all weights that move in one vector, of which those by name are parts
        self.moving = [k for k in w if k != "bias"]
        self.flat = np.concatenate([w[k].ravel() for k in self.moving])
        cut = np.cumsum([w[k].size for k in self.moving])[:-1]
        self.w = {**w, **{k: v.reshape(w[k].shape) for k, v in zip(self.moving, np.split(self.flat, cut), strict=True)}}
        self.m, self.u = np.zeros_like(self.flat), np.zeros_like(self.flat)
        self.rate, self.members, self.batch, self.t, self.seen = rate, members, batch, 0, 0

    def feed(self, x: np.ndarray, y: np.ndarray, row: np.ndarray, live: np.ndarray) -> None:
        order = np.random.default_rng(len(x)).permutation(len(x))
        x, y, row, live = (m.take(order, 0) for m in (x, y, row, live))
        for at in range(0, len(x), self.batch):
            i = slice(at, at + self.batch)
            _, g = backward(self.w, x[i], y[i], live[i].astype(np.float32), self.members, row[i])
            g = np.concatenate([g[k].ravel() for k in self.moving])
            self.t += 1
            self.seen += len(x[i])
            step = self.rate / (1 - 0.9**self.t)
            damp = np.float32(1 / (1 - 0.98**self.t))
            self.m += np.float32(0.1) * (g - self.m)
            g *= g
            g -= self.u
            g *= np.float32(0.02)
            self.u += g
            np.sqrt(np.multiply(self.u, damp, out=g), out=g)
            g += np.float32(1e-6)
            self.flat -= np.divide(np.float32(step) * self.m, g, out=g)


def windows_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first scored place) of each window, for documents of n ids. The first window scores all its places."""
    step = WINDOW - OVERLAP
    count = 1 + np.maximum(0, -(-(n - WINDOW) // step))
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, np.where(k == 0, 0, WINDOW + (k - 1) * step)


def _laid_out(ids: pa.Array):
    """All ids of a batch in a row, and where each document starts and ends."""
    ids = ids.cast(pa.large_binary())
    at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 2
    flat = np.frombuffer(ids.buffers()[2], "<u2") if len(ids) else np.zeros(0, np.uint16)
    return flat, at


def tiles(flat: np.ndarray, at: np.ndarray, end_id: int):
    """(before, target, live), [windows, WINDOW] each: all ids in windows side by side, each text's last one filled up."""
    n = np.diff(at)
    size = -(-n // WINDOW) * WINDOW
    place = np.arange(int(n.sum())) + np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n)
    own = flat[at[0] : at[-1]]
    last = np.empty_like(own)
    last[1:] = own[:-1]
    last[(at[:-1] - at[0])[n > 0]] = end_id
    before, target, live = (np.zeros(int(size.sum()), d) for d in (own.dtype, own.dtype, bool))
    before[place], target[place], live[place] = last, own, True
    return (m.reshape(-1, WINDOW) for m in (before, target, live))


def train(documents: DataFrame, classes: Classes, end_id: int, rounds: int = ROUNDS) -> tuple[dict, int]:
    """Weights after a pass over all ids of all training documents, in windows side by side, and the number of windows.

    A round takes the documents whose hash falls to it; each task goes on from the
    common weights through its windows, a slice of text at a time, and the round
    ends in the tasks' mean, weighted by their windows.
    """
    w = new_weights(classes.start)
    shapes = {k: v.shape for k, v in w.items() if k != "bias"}
    pack = lambda m: np.concatenate([m[k].ravel() for k in shapes])

    def unpack(v):
        out, at = {"bias": classes.start}, 0
        for k, s in shapes.items():
            out[k] = v[at : at + (n := int(np.prod(s)))].reshape(s).astype(np.float32)
            at += n
        return out

    spark = documents.sparkSession
    training = documents.where("not held_out").select("ids")
    windows = 0
    tables = spark.sparkContext.broadcast((classes.of.astype(np.int8), classes.slot.astype(np.int16), classes.row.astype(np.int16), classes.start, Members(classes)))
    for r in range(rounds):
        held = spark.sparkContext.broadcast(pack(w))

        def local(batches, r=r, held=held):
            of, slot, row, start, members = tables.value
            out, at = {"bias": start}, 0
            for k, s in shapes.items():
                out[k] = held.value[at : at + (n := int(np.prod(s)))].reshape(s).astype(np.float32)
                at += n
            descent = Descent(out, 0.02 / (1 + 2 * r), members)
            for b in (part for batch in batches for part in slices(batch, 0, IDS_BYTES)):
                flat, at = _laid_out(b.column(0))
                before, target, live = tiles(flat, at, end_id)
                descent.feed(slot.take(before), of.take(target), row.take(target), live)
            if descent.seen:
                yield pa.RecordBatch.from_arrays([pa.array([(pack(descent.w).astype(np.float64) * descent.seen).tobytes()], pa.binary()), pa.array([float(descent.seen)])], names=["w", "n"])

        def add(batches):
            total, n = None, 0.0
            for b in batches:
                for x, k in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    v = np.frombuffer(x.as_buffer(), np.float64)
                    total, n = (v.copy() if total is None else total + v), n + k
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n])], names=["w", "n"])

        # a round's documents go by a hash of what they hold
        sums = training.where(F.pmod(F.xxhash64("ids"), F.lit(rounds)) == r).mapInArrow(local, "w binary, n double").repartition(16).mapInArrow(add, "w binary, n double").collect()  # at most 16 rows
        if sums:
            n = sum(s["n"] for s in sums)
            w = unpack(sum(np.frombuffer(s["w"], np.float64) for s in sums) / n)
            windows += int(n)
    return w, windows


def score_ids(flat: np.ndarray, at: np.ndarray, scorer: Scorer, c: Classes, end_id: int, batch: int = 256, members: Members | None = None) -> np.ndarray:
    """log10 probability of each document's ids."""
    if len(flat) == 0:
        return np.zeros(len(at) - 1)
    members = members or Members(c)
    low, flat = at[0], flat[at[0] : at[-1]]
    at = at - low
    # what doesn't depend on the window, once for each id
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    before[at[:-1][np.diff(at) > 0]] = end_id
    x, own, row = c.slot.take(before), c.of.take(flat), c.slot.take(flat)
    exact = (own >= BEGIN) & (x < OWN) & (row < OWN)
    p, rest, exact = np.empty(len(flat), np.float32), np.flatnonzero(~exact), np.flatnonzero(exact)
    p[exact] = c.pair.reshape(-1).take(x.take(exact) * OWN + row.take(exact))
    p[rest] = c.within.reshape(-1).take(np.where(own.take(rest) < BEGIN, CLASSES, c.of.take(before.take(rest))) * c.within.shape[1] + flat.take(rest))
    doc, first = windows_of(np.diff(at))
    start = at[:-1][doc] + np.maximum(0, first - OVERLAP)
    first = at[:-1][doc] + first
    end = at[1:][doc]
    ones = np.ones(CLASSES, np.float32)
    state = np.empty((len(flat), WIDTH), np.float32)
    done = 0
    for i in range(0, len(doc), batch):
        j = slice(i, i + batch)
        place = start[j, None] + np.arange(WINDOW)
        scored = np.flatnonzero((place >= first[j, None]) & (place < end[j, None]))
        np.minimum(place, len(flat) - 1, out=place)  # beyond a text's end nothing is scored, and nothing before sees it
        h = scorer.states(x.take(place), scored)
        place = slice(done, done := done + len(scored))  # windows score the ids in their order
        state[place] = h
        for r in range(0, len(h), RUN):
            some = slice(place.start + r, min(place.start + r + RUN, done))
            z = scorer.logits(x[some], h[r : r + RUN])
            got = z.take(FIRST[: len(z)] + own[some])
            np.exp(z, out=z)
            got -= np.log(z @ ones)
            p[some] += got
    order, _, groups = members.groups(own)
    row, u = c.row.take(flat), scorer.w["ids"]
    among = u.take(members.all, 0)
    for k, i, n in groups:
        for part in (order[s : min(s + 2048, i.stop)] for s in range(i.start, i.stop, 2048)):
            h = state.take(part, 0)
            q = members.odds([(k, slice(0, len(part)), n)], h, x.take(part), among)[1][0]
            p[part] += _dots(h, u.take(row.take(part), 0))[:, 0] - np.log(q @ np.ones(q.shape[1], q.dtype))
    sums = np.concatenate([[0.0], np.cumsum(p, dtype=np.float64)])
    return (sums[at[1:]] - sums[at[:-1]]) / np.log(10)


def score_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 50256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_ids."""
    documents, stats = tokenised(docs, path, pattern, end_id, id_col, text_col)
    kind = documents.schema["doc_id"].dataType.simpleString()
    trained = documents.where("not held_out").count()
    words, distinct = stats.where("kind = 3").agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    n, v = words + trained, distinct + (trained > 0)
    ranks = _encoding(path, pattern)
    begins = np.zeros(max(end_id, ranks.max_token_value) + 1, bool)
    for i in range(ranks.max_token_value + 1):
        begins[i] = ranks.decode_single_token_bytes(i)[:1] == b" "
    begins[end_id] = True
    classes = classes_of(stats, begins, end_id, trained)
    weights, _ = train(documents, classes, end_id)
    held = docs.sparkSession.sparkContext.broadcast((weights, classes, Members(classes)))

    def run(batches):
        w, c, members = held.value
        scorer = Scorer(w)
        for b in batches:
            parts = [_laid_out(x.column(4)) for x in slices(b, 4, IDS_BYTES)]
            scores = np.concatenate([score_ids(flat, at, scorer, c, end_id, members=members) for flat, at in parts] or [np.zeros(0)])
            sizes = np.concatenate([np.diff(at) for _, at in parts] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(scores), pa.array(sizes), b.column(5)], names=["doc_id", "held_out", "n_words", "n_known", "score", "n_ids", "known_sum"])

    head = documents.select("doc_id", "held_out", "n_words", "n_known", "ids", "known_sum")
    scored = head.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_words bigint, n_known bigint, score double, n_ids bigint, known_sum double")
    end_log = float(np.log10(trained + 0.1))
    each = float(np.log10(n + 0.1 * (v + 1)))
    return scored.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + F.lit(1 if trained else 0)).cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("known_sum") + F.lit(end_log) - (F.col("n_words") + 1) * F.lit(each)).alias("base_score"), "score", "n_ids",
    )
