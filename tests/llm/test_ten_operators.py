"""Each operator against a brute-force version, on a fixture with nulls, empty and long texts, ties, copies and repeated rows."""

import functools
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ploidia.llm import bpe, exact_dedup, exchange, fingerprints, line_dedup, lm_scoring, mixing, near_copies, quality, shared, simhash, suffix_dedup, token_store

SCHEMA = "doc_id long, text string, source string, rid string, name string, h long, `a.b` string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall(t or "")


def rows_of():
    rng = random.Random(4)
    vocab = [a + b for a in ("an", "er", "th", "on", "ré", "ü") for b in ("the", "ti", "sh", "nd", "é", "a", "ou")]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(30)
    texts = [None, "", " ", "\n\t", "One", "one", "ONE", "Été", "ÉTÉ", "a b c", text(3000), "x" * 9000, passage]
    texts += [text(rng.randint(1, 120)) for _ in range(30)]
    texts += [t for t in texts[13:18]]
    texts += [passage + " " + text(20), text(10) + "\n" + passage + "\n" + text(5), "<|endoftext|> mid <|endoftext|>", "tabs\tand  blanks \r\n here ", "ta b   c \n\nd", "日本語 テキスト 日本語"]
    texts += [texts[20].replace("the", "thee", 1), texts[20].upper()]
    out = [(i, t, None if i % 11 == 0 else f"src{i % 4}" if i % 3 else "hot", "r", "n", 1, "x") for i, t in enumerate(texts)]
    return [*out, out[5], out[20]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(docs):
    return sorted(r[0] for r in docs.select("doc_id").collect())


# 1 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_exact_groups(docs, block):
    got = exact_dedup.exact_groups(docs, block_bytes=block).collect()
    rows = [(r[0], (r[1] or "").translate(LOW)) for r in rows_of()]
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    text = dict(rows)
    for r in got:
        same = [i for i, t in rows if t == text[r.doc_id]]
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(same), len(same), hashlib.sha256(text[r.doc_id].encode()).hexdigest())
    assert sum(r.kept for r in got) == len(set(text.values()))


def test_drop_exact_copies(docs):
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [(t or "").translate(LOW) for (t,) in kept.select("text").collect()]
    assert len(texts) == len(set(texts)) == len({(r[1] or "").translate(LOW) for r in rows_of()})


def test_exact_null_ids(spark):
    d = spark.createDataFrame([(None, "a"), (None, "a"), (3, "A"), (None, None)], "doc_id long, text string")
    got = exact_dedup.exact_groups(d).collect()
    assert sorted((r.group_size, r.keep_id, r.kept) for r in got if r.text_sha256 == hashlib.sha256(b"a").hexdigest()) == [(3, 3, False), (3, 3, False), (3, 3, True)]
    assert exact_dedup.drop_exact_copies(d).count() == 2


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_lm_scoring(docs):
    got = lm_scoring.score_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    rows = [(r[0], [w for w in words((r[1] or "").translate(LOW))]) for r in rows_of()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = {}
    for i, w in rows:
        if not held(i):
            for x in [*w, None]:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    want = {i: (held(i), len(w) + 1, sum(count.get(x, 0) > 0 for x in [*w, None]), n, sum(math.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in [*w, None])) for i, w in rows}
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], abs=1e-6)
        assert np.isfinite(r.score) and r.score < 0
    # the same words and counts by way of several levels, however rows are dealt
    other, stats = lm_scoring.tokenised(docs.repartition(5), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50256, "doc_id", "text", block_bytes=512, radix=3)
    one, stats_one = lm_scoring.tokenised(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50256, "doc_id", "text")
    key = lambda r: (r.doc_id, r.held_out, r.n_words, r.n_known, round(r.known_sum, 6), bytes(r.ids))
    assert sorted(map(key, other.collect())) == sorted(map(key, one.collect()))
    assert sorted(stats.collect()) == sorted(stats_one.collect())
    encode = lm_scoring._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).encode_ordinary
    text = dict(rows)
    for r in one.collect():
        assert np.frombuffer(r.ids, "<u2").tolist() == [i for w in text[r.doc_id] for i in encode(" " + w)] + [50256]


def test_lm_texts_are_packed_once(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    d = spark.read.parquet(str(tmp_path / "d")).select("doc_id", "text")
    out, _ = lm_scoring.tokenised(d.mapInArrow(counted, d.schema), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, 50256, "doc_id", "text")
    assert seen.value == d.count() == out.count()


def test_lm_words_stand_in_one_order_whatever_their_hashes(monkeypatch):
    one, other = pa.array(["b", "a", "c", "b", "é"], pa.large_string()), pa.array(["é", "c", "b", "a"], pa.large_string())
    for hashes in (lm_scoring.word_hashes, lambda w: np.zeros(len(w), np.uint64)):
        monkeypatch.setattr(lm_scoring, "word_hashes", hashes)
        codes, words = lm_scoring._coded(one)
        assert words.take(pa.array(codes)) == one and len(words) == 4
        assert lm_scoring._coded(other)[1] == words
    assert words.to_pylist() == ["a", "b", "c", "é"]  # equal hashes: by bytes


def test_windows_score_each_id_once():
    for n in (1, 31, 32, 33, 58, 59, 500):
        doc, first = lm_scoring.windows_of(np.array([n]))
        seen = np.zeros(n, int)
        for f in first:
            start = max(0, f - lm_scoring.OVERLAP)
            seen[f : min(n, start + lm_scoring.WINDOW)] += 1
        assert (seen == 1).all(), n


def _classes(n=60):
    rng = np.random.default_rng(0)
    of = np.arange(n) % lm_scoring.CLASSES
    within = np.full((lm_scoring.CLASSES + 1, n), -50.0)
    for c in range(lm_scoring.CLASSES + 1):
        for k in np.unique(of):
            p = rng.random((of == k).sum()) + 0.1
            within[c, of == k] = np.log(p / p.sum())
    start = rng.standard_normal((lm_scoring.OWN + lm_scoring.CLASSES, lm_scoring.CLASSES)).astype(np.float32)
    return lm_scoring.Classes(of, np.full(n, lm_scoring.OWN) + of, within.astype(np.float32), np.zeros((lm_scoring.OWN, lm_scoring.OWN), np.float32), start)


def test_scores_are_probabilities_and_causal():
    c = _classes()
    w = lm_scoring.Scorer(lm_scoring.new_weights(c.start))
    logs = [lm_scoring.score_ids(np.array([7, 3, x], np.uint16), np.array([0, 3]), w, c, 0)[0] for x in range(60)]
    two = lm_scoring.score_ids(np.array([7, 3], np.uint16), np.array([0, 2]), w, c, 0)[0]
    used = len(set(c.of.tolist()))
    assert used <= lm_scoring.CLASSES
    assert sum(10 ** (x - two) for x in logs) <= 1 + 1e-3
    # masked batches give what one id at a time gives
    one = np.random.default_rng(1).integers(0, 60, 40).astype(np.uint16)
    flat, at = np.concatenate([one, one[:5]]), np.array([0, 40, 45])
    assert lm_scoring.score_ids(flat, at, w, c, 0)[1] == pytest.approx(lm_scoring.score_ids(one[:5], np.array([0, 5]), w, c, 0)[0], abs=1e-4)


def _plain_logs(w, c, ids, end_id):
    """log P(class) at each place of a window, place by place, by the formula."""
    x = [c.slot[i] for i in [end_id, *ids[:-1]]]
    e = [w["emb"][r] + w["pos"][t] for t, r in enumerate(x)]
    q, k, v = (np.stack([r @ w["qkv"][:, i * lm_scoring.WIDTH : (i + 1) * lm_scoring.WIDTH] for r in e]) for i in range(3))
    out = []
    for t in range(len(ids)):
        s = np.exp(k[: t + 1] @ q[t])
        z = (e[t] + (s / s.sum()) @ v[: t + 1] @ w["out"]) @ w["cls"] + w["bias"][x[t]]
        out.append(z - np.log(np.exp(z).sum()))
    return out


def test_scores_by_the_formula():
    c = _classes()
    w = lm_scoring.new_weights(c.start)
    ids = np.random.default_rng(4).integers(0, 60, 40).astype(np.uint16)
    step = lm_scoring.WINDOW - lm_scoring.OVERLAP
    want = 0.0
    for p in range(40):
        start = 0 if p < lm_scoring.WINDOW else lm_scoring.WINDOW + (p - lm_scoring.WINDOW) // step * step - lm_scoring.OVERLAP
        part = ids[start : start + lm_scoring.WINDOW]
        log = _plain_logs(w, c, part.tolist(), 0 if start == 0 else int(ids[start - 1]))[p - start][c.of[ids[p]]]
        before = lm_scoring.CLASSES if c.of[ids[p]] < lm_scoring.BEGIN else c.of[ids[p - 1] if p else 0]
        want += log + c.within[before, ids[p]]
    got = lm_scoring.score_ids(ids, np.array([0, 40]), lm_scoring.Scorer(w), c, 0)[0]
    assert got == pytest.approx(want / np.log(10), abs=1e-3)


def test_gradients():
    c = _classes()
    w = {k: v.astype(np.float64) for k, v in lm_scoring.new_weights(c.start).items()}
    rng = np.random.default_rng(2)
    x, y, live = rng.integers(lm_scoring.OWN, lm_scoring.OWN + 20, (2, 9)), rng.integers(0, 60, (2, 9)), np.ones((2, 9))
    _, g = lm_scoring.backward(w, x, y, live)
    assert set(g) == set(w) - {"bias"}
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        slope = (lm_scoring.backward(up, x, y, live)[0] - lm_scoring.backward(down, x, y, live)[0]) / 2e-4
        assert g[k][at] == pytest.approx(slope, rel=2e-2, abs=1e-4), k


def _rows_of_their_own(n=60):
    """Classes of three and more ids, where ids below 40 have rows of their own, and the others of a class share one of two bands."""
    rng = np.random.default_rng(5)
    c = _classes(n)
    of = np.arange(n) % 3 + np.where(np.arange(n) % 2, lm_scoring.BEGIN, 0)
    slot = np.where(np.arange(n) < 40, np.arange(n), lm_scoring.OWN + of)
    of = np.where(slot < lm_scoring.OWN, of, np.where(of < lm_scoring.BEGIN, lm_scoring.BEGIN - 1, lm_scoring.CLASSES - 1))
    slot = np.where(slot < lm_scoring.OWN, slot, lm_scoring.OWN + of)
    within, pair = np.full((lm_scoring.CLASSES + 1, n), -50.0, np.float32), np.full((lm_scoring.OWN, lm_scoring.OWN), -40.0, np.float32)
    for k in np.unique(of):
        ids = np.flatnonzero(of == k)
        share = lambda rows: np.log((p := rng.random((rows, len(ids))) + 0.1) / p.sum(1, keepdims=True))  # noqa: E731, B023
        within[:, ids] = share(len(within))
        if ids[0] < 40:
            pair[:, ids] = share(len(pair))
    row = np.where(slot < lm_scoring.OWN, slot, lm_scoring.OWN + lm_scoring.CLASSES + lm_scoring.BANDS * (of >= lm_scoring.BEGIN) + np.arange(n) % 4 // 2)
    return lm_scoring.Classes(of, slot, within, pair, c.start, row)


def _stirred(c):
    """Weights as training might leave them, with no part at its starting point."""
    rng = np.random.default_rng(8)
    return {k: v if k == "bias" else v + (rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in lm_scoring.new_weights(c.start).items()}


def test_ids_within_their_class_go_by_the_context():
    c = _rows_of_their_own()
    w = _stirred(c)
    w["bias"][:, np.setdiff1d(np.arange(lm_scoring.CLASSES), c.of)] = -40  # classes of no id
    score = lambda ids: lm_scoring.score_ids(np.array(ids, np.uint16), np.array([0, len(ids)]), lm_scoring.Scorer(w), c, 0)[0]
    after = lambda *head: np.array([score([*head, i]) for i in range(60)]) - score(head)
    one, other = after(7, 3, 12), after(30, 41, 12)
    for p in (one, other):  # all ids together have probability 1
        assert (10**p).sum() == pytest.approx(1, abs=1e-3)
    for k in np.unique(c.of):  # the same id stands before: odds between ids of a class follow what is further back
        ids = np.flatnonzero(c.of == k)
        assert np.ptp((one - other)[ids]) > 1e-3, k


def test_gradients_of_the_whole_block():
    c = _rows_of_their_own()
    m = lm_scoring.Members(c)
    w = {k: v.astype(np.float64) for k, v in _stirred(c).items()}
    rng = np.random.default_rng(2)
    ids, y = rng.integers(0, 60, (2, 9)), rng.integers(0, 60, (2, 9))
    live = rng.random((2, 9)) < 0.8
    loss = lambda w: lm_scoring.backward(w, c.slot[ids], c.of[y], live, m, c.row[y])
    g = loss(w)[1]
    assert set(g) == set(w) - {"bias"} and all(np.abs(v).max() > 1e-5 for v in g.values())
    for k in g:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        up, down = ({**w, k: w[k].copy()} for _ in range(2))
        up[k][at] += 1e-4
        down[k][at] -= 1e-4
        assert g[k][at] == pytest.approx((loss(up)[0] - loss(down)[0]) / 2e-4, rel=1e-3, abs=1e-6), k


def test_tiles_hold_every_id_once():
    flat, at = np.arange(1, 60).astype("<u2"), np.array([4, 4, 5, 21, 54])
    before, target, live = lm_scoring.tiles(flat, at, 99)
    assert target[live].tolist() == flat[4:54].tolist() and before.shape[1] == lm_scoring.WINDOW
    assert before[live].tolist() == [99, 99, *flat[5:20].tolist(), 99, *flat[21:53].tolist()]
    assert not target[~live].any() and all((np.diff(row.astype(int)) <= 0).all() for row in live)


def test_training_takes_every_window(spark):
    c = _classes()
    rng = np.random.default_rng(6)
    # ids that repeat what came before them: attention must learn to look back
    texts = [np.tile(rng.integers(0, 60, 5), 30)[: int(n)].astype("<u2") for n in rng.integers(0, 150, 300)]
    d = spark.createDataFrame([(i % 10 == 0, t.tobytes()) for i, t in enumerate(texts)], "held_out boolean, ids binary").repartition(3)
    w, windows = lm_scoring.train(d, c, 0)
    assert windows == sum(-(-len(t) // lm_scoring.WINDOW) for i, t in enumerate(texts) if i % 10)
    held = [t for i, t in enumerate(texts) if i % 10 == 0]
    flat, at = np.concatenate(held), np.concatenate([[0], np.cumsum([len(t) for t in held])])
    score = lambda w: lm_scoring.score_ids(flat, at, lm_scoring.Scorer(w), c, 0).sum()
    assert score(w) > score(lm_scoring.new_weights(c.start))


# 3 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("radix", [3, 256])
def test_repeated_spans(docs, radix):
    got = suffix_dedup.repeated_spans(docs, length=50, block_bytes=1 << 10, radix=radix).collect()
    rows = sorted((r[0], (r[1] or "").encode()) for r in rows_of())
    seen, want = set(), {}
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        fresh = set()
        for i, b in group:
            cover = np.zeros(len(b), bool)
            for p in range(len(b) - 49):
                if b[p : p + 50] in seen:
                    cover[p : p + 50] = True
                fresh.add(b[p : p + 50])
            want[i] = (len(b), bytes(np.frombuffer(b, np.uint8)[~cover]))
        seen |= fresh
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    assert any(len(k) < n for n, k in want.values())
    for r in got:
        assert (r.n_bytes, bytes(r.kept)) == want[r.doc_id]
        assert sum(e - s for s, e in r.spans) == r.n_bytes - len(r.kept)


def _index(strings, length, weight):
    import pyarrow as pa

    return suffix_dedup.RunIndex(pa.array(strings, pa.large_binary()), length, np.array(weight))


def _streamed(index, patterns):
    import pyarrow as pa

    first, out = index.stream(pa.array(patterns, pa.large_binary()), batch=7)
    return [out[a:b].tolist() for a, b in zip(first, [*first[1:], len(out)], strict=True)]


def test_run_index_is_compressed():
    strings = [b"abcabcabcabcabcabc" * 9, b"bcabcabca" * 9]
    index = _index(strings, 10, [5, 2])
    assert len(index.run_start) < index.n / 4
    assert set(_streamed(index, strings)[0]) == {2}


def _repetitive(rng):
    base = bytes(rng.choice(b"abcd") for _ in range(60))
    strings = set()
    for _ in range(40):
        s = bytearray(base[rng.randint(0, 20) : rng.randint(30, 60)])
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(len(s))] = rng.choice(b"abcd\0")
        strings.add(bytes(s))
    return sorted(strings)


@pytest.mark.parametrize("seed", range(6))
def test_streaming_any_pattern(seed):
    rng = random.Random(seed)
    strings, length = _repetitive(rng), rng.choice([8, 9, 12, 16, 20])
    weight = [rng.randint(0, 99) for _ in strings]
    index = _index(strings, length, weight)
    # patterns that the index has, parts of them put together, and strangers with bytes it has not
    patterns = strings + [rng.choice(strings)[-15:] + rng.choice(strings)[:25] for _ in range(60)] + [bytes(rng.choice(b"abcdez") for _ in range(30)) for _ in range(20)] + [b"", b"a"]
    least = lambda w: min((x for s, x in zip(strings, weight, strict=True) if w in s), default=suffix_dedup.LATE)
    assert _streamed(index, patterns) == [[least(p[i : i + length]) for i in range(max(0, len(p) - length + 1))] for p in patterns]


def test_streaming_needs_the_samples():
    rng = random.Random(1)
    strings = _repetitive(rng)
    patterns = strings + [rng.choice(strings)[-15:] + rng.choice(strings)[:25] for _ in range(60)]
    right = _streamed(_index(strings, 12, range(len(strings))), patterns)
    for wrong in ("start_position", "end_position"):
        index = _index(strings, 12, range(len(strings)))
        setattr(index, wrong, np.zeros_like(getattr(index, wrong)))
        assert _streamed(index, patterns) != right, wrong


def test_suffixes_are_sorted():
    rng = random.Random(5)
    for _ in range(20):
        strings = [s for s in _repetitive(rng) if s]
        t = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
        ends = np.cumsum([len(s) + 1 for s in strings]) - 1
        rows, new = suffix_dedup.sorted_suffixes(t, ends, 20)
        stop = {p: e for p, e in zip(range(len(t)), np.repeat(ends, np.diff(ends, prepend=-1)).tolist(), strict=True)}
        suffix = lambda p: bytes(t[p : stop[p]])
        assert rows.tolist() == sorted(range(len(t)), key=lambda p: (suffix(p), p))
        for i in range(1, len(rows)):
            a, b = suffix(rows[i - 1]), suffix(rows[i])
            if len(a) >= 20 and len(b) >= 20:
                assert new[i] == (a[:20] != b[:20])


def test_minimizers_are_those_of_the_stretches():
    import pyarrow as pa

    rng = random.Random(2)
    texts = pa.array([bytes(rng.choice(b"ab c") for _ in range(n)) for n in (200, 49, 50, 51, 0, 700)], pa.large_binary())
    s = suffix_dedup.stretches(texts, 50)
    strings = suffix_dedup.gathered(s.data, s.first, s.windows + 49)
    assert (suffix_dedup.minimizers_of(strings) == s.value).all() and len(s.value) > 20


@pytest.mark.parametrize("length", [17, 50, 64])
def test_minimizers_of_stretches_take_one_window(length):
    rng = np.random.default_rng(9)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (0, 10, 50, 64, 400, 3000)] * 30
    s = suffix_dedup.stretches(pa.array(texts, pa.large_binary()), length)
    strings = suffix_dedup.gathered(s.data, s.first, s.windows + length - 1)
    assert (suffix_dedup.minimizers_of(strings, length) == s.value).all() and len(strings) > suffix_dedup.PIECE // (2 * length)
    assert (suffix_dedup.minimizers_of(strings.slice(7, 40), length) == s.value[7:47]).all()
    # of a stretch, no more than its first window is read
    cut = suffix_dedup.gathered(s.data, s.first, np.full(len(s.first), length))
    assert (suffix_dedup.minimizers_of(cut, length) == s.value).all()
    assert len(suffix_dedup.minimizers_of(strings.slice(0, 0), length)) == 0


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_patience():
    a, b = list("abcdefg"), list("xbcdyfgz")
    assert [(a[i], b[j]) for i, j in line_dedup.patience(a, b)] == [(c, c) for c in "bcdfg"]
    assert line_dedup.patience([], b) == [] and line_dedup.patience(list("aaa"), list("aa")) == [(0, 0), (1, 1)]


def test_lines_go_from_later_documents(spark):
    line = lambda i: f"this is a line of text number {i} and it is long enough to count"
    rows = [(1, "\n".join(map(line, range(6)))), (2, "own line that nobody else has in this table\n" + line(2) + "\n" + line(3)), (3, line(4)), (4, line(4)), (5, "short\nshort"), (6, None), (7, ""), (7, line(4))]
    got = {(r.doc_id, r.n_lines): r for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_removed for k in ((1, 6), (2, 3), (3, 1), (4, 1), (5, 2), (6, 1))] == [0, 2, 1, 1, 0, 0]
    assert got[(2, 3)].kept == "own line that nobody else has in this table"


def test_frequent_passages_of_short_lines_go(spark):
    passage = "a first line of thirty-eight characters\nand its second"
    rows = [(i, f"an own line of document number {i}, held by nobody else here\n{passage}") for i in range(70)]
    got = {r.doc_id: r for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0
    assert all(list(got[i].removed) == [1, 2] for i in range(1, 70))


def test_blocks_whose_lines_stand_elsewhere_first_go(spark):
    one, two = "a line of forty characters, more or less", "another line of some forty characters"
    rows = [(1, "x\n" + one), (2, two + "\ny"), (3, f"own three\n{one}\n{two}"), (4, f"own four\n{one}\n{two}\nend"), (5, f"{two}\n{one}")]
    got = {r.doc_id: list(r.removed) for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [], 3: [], 4: [1, 2], 5: []}


def test_shortest_runs_cover_every_common_block(spark):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 5, 12, 20, 24, 30, 40, 48, 60)]
    texts = [[rng.choice(lines) for _ in range(rng.randint(1, 8))] for _ in range(60)]
    got = {r.doc_id: set(r.removed) for r in line_dedup.drop_common_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    seen = set()
    for i, t in enumerate(texts):
        runs = {(s, e): tuple(t[s:e]) for s in range(len(t)) for e in range(s + 1, len(t) + 1)}
        block = lambda r: sum(map(len, r)) >= 48 and max(map(len, r)) >= 24
        want = {p for (s, e), r in runs.items() if block(r) and r in seen for p in range(s, e)}
        assert want <= got[i]
        seen |= set(runs.values())


def _patience(a, b):
    """Matched positions by recursion: equal ends, then lines unique in both in a longest common order, then the gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in _patience(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return _patience(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    once = [(a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1]
    best = []  # best[k]: a longest rising chain that ends in once[k], the first of its length
    for k, (_, j) in enumerate(once):
        fits = [best[m] for m in range(k) if once[m][1] < j]
        best.append(max(fits, key=len, default=[]) + [once[k]])
    if not best:
        return []
    longest = max(map(len, best))
    chain = min((c for c in best if len(c) == longest), key=lambda c: [j for _, j in reversed(c)])
    out, s, t = [], 0, 0
    for i, j in [*chain, (len(a), len(b))]:
        out += [(s + x, t + y) for x, y in _patience(a[s:i], b[t:j])] + [(i, j)]
        s, t = i + 1, j + 1
    return out[:-1]


def _lines_gone(texts, min_line=24, min_block=48):
    """By documents in order: what patience alignment with the first holder of each long line removes, and every run that is a block and stood before."""
    first, runs, out = {}, set(), []
    for i, text in enumerate(texts):
        t = [x.strip(" ") for x in (text or "").split("\n")]
        gone = set()
        for a in {first[x] for x in t if len(x) >= min_line and x in first}:
            other = [x.strip(" ") for x in (texts[a] or "").split("\n")]
            pairs = _patience(other, t)
            for _, g in itertools.groupby(enumerate(pairs), key=lambda x: (x[1][0] - x[0], x[1][1] - x[0])):
                block = [j for _, (_, j) in g]
                if sum(len(t[j]) for j in block) >= min_block:
                    gone |= set(block)
        own = {}
        for s in range(len(t)):
            for e in range(s + 1, min(len(t), s + 8) + 1):
                own[s, e] = tuple(t[s:e])
        for (s, e), r in own.items():
            if r in runs:
                gone |= set(range(s, e))
        runs |= {r for r in own.values() if sum(map(len, r)) >= min_block and max(map(len, r)) >= min_line}
        for x in t:
            first.setdefault(x, i)
        out.append(sorted(gone))
    return out


@pytest.mark.parametrize("part", [3, 250])
def test_lines_against_brute_force(spark, part):
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (0, 6, 7, 12, 13, 20, 24, 25, 30, 33, 40, 47, 48, 60)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 7))) for _ in range(150)] + [None, ""]
    # long documents, one of 20,000 words, and one that repeats it with a change
    long = ["\n".join(f"line {i} of a long document has its eight own words{' here' * 2}" for i in range(2000))]
    long.append(long[0].replace("line 700 of", "line 7oo of"))
    texts += long
    table = [(i, t, i, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: list(r.removed) for r in line_dedup.drop_common_lines(spark.createDataFrame(table, "doc_id long, text string, rid long, h string").repartition(5), part=part).collect()}
    want = _lines_gone(texts[:-2])
    assert [got[i] for i in range(len(want))] == want
    assert got[len(texts) - 2] == [] and got[len(texts) - 1] == [i for i in range(2000) if i != 700]


@pytest.mark.parametrize("holders", [2, 64, 65, 500])
def test_number_of_holders_changes_nothing(spark, holders):
    shapes = (["a line of thirty characters, ok"] * 1 + ["and one more of twenty-seven"], ["another single line of more than forty-eight characters"], ["nine chars"] * 0 + ["twelve chars", "thirteen char", "fourteen chars", "fifteen charss"], ["no block, but a long line of 38 chars."])
    texts = []
    for i in range(holders):
        texts.append("\n".join(x for k, shape in enumerate(shapes) for x in [f"own {k} of {i}, which no other holds", *shape]))
    got = {r.doc_id: list(r.removed) for r in line_dedup.drop_common_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == []
    assert all(got[i] == [1, 2, 4, 6, 7, 8, 9] for i in range(1, holders))


def test_lines_of_null_and_equal_ids(spark):
    t = "a line that is long enough to be a block by itself, surely"
    rows = [(None, t), (None, t), (4, t), (4, t), (3, "x\n" + t)]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(3, 2, 1), (4, 1, 1), (4, 1, 1), (None, 1, 0), (None, 1, 1)]


def test_first_holder_keeps_every_line(docs):
    got = line_dedup.drop_common_lines(docs).collect()
    assert len(got) == len(rows_of())
    kept = {x.strip() for r in got for x in r.kept.split("\n")}
    for _, t, *_ in rows_of():
        for x in (t or "").split("\n"):
            assert x.strip(" ") in {k.strip(" ") for k in kept} or x.strip() in kept


# 5 ---------------------------------------------------------------------------------------------------------------------


def h64(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
        seed_signed = seed - (1 << 64) if seed >> 63 else seed
    return seed_signed


def winnowed(t, k=5, w=4):
    hs = [h64(x) for x in words(t)]
    grams = [h64(*hs[i : i + k]) for i in range(len(hs) - k + 1)] if len(hs) >= k else [functools.reduce(h64, hs, 42)] if hs else []
    spans = [range(i, i + w) for i in range(len(grams) - w + 1)] if len(grams) >= w else [range(len(grams))] if grams else []
    return [(grams[i], i) for i in sorted({max(s, key=lambda i: (-grams[i], i)) for s in spans})]


def test_winnowing(docs):
    got = {}
    for r in fingerprints.edited_and_next(docs, range_rows=10).collect():
        got.setdefault(r.doc_id, []).append(r)
    rows = sorted(((r[0], r[1] or "") for r in rows_of()))
    assert sum(map(len, got.values())) == len(rows)
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, b, c = ({h for h, _ in winnowed(x)} for x in (t, edited, nxt))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want = (len(t), hashlib.sha256(edited.encode()).hexdigest(), " ".join(f"{p}:{h & (1 << 64) - 1:x}" for h, p in winnowed(t)), like(a, b), like(a, c))
        assert want in [(r.n_chars, r.edited_sha256, r.fingerprint, r.near_edited, r.near_next) for r in got[i]]


def test_winnowing_guarantee():
    rng = random.Random(1)
    shared = [str(rng.random()) for _ in range(8)]
    a, b = ([str(rng.random()) for _ in range(20)] + shared + [str(rng.random()) for _ in range(20)] for _ in range(2))
    assert {h for h, _ in winnowed(" ".join(a))} & {h for h, _ in winnowed(" ".join(b))}


# 6 ---------------------------------------------------------------------------------------------------------------------


def simhash_of(t, k=4):
    w = words((t or "").translate(LOW))
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, radius):
    own = list(range(len(fps)))

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= radius:
            own[root(j)] = root(i)
    return [root(i) for i in range(len(fps))]


def test_simhash(docs):
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect())
    rows = sorted(rows_of(), key=lambda r: r[0])
    fps = [simhash_of(r[1]) for r in rows]
    own = components(fps, 4)
    least = [min(r[0] for r, o in zip(rows, own, strict=True) if o == mine) for mine in own]
    assert got == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, least, strict=True))


@pytest.mark.parametrize("radius", [1, 4, 6])
def test_covering_masks_cover(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(m & flips == 0 for m in masks)


def test_distance_counts_the_sign_bit():
    a = np.array([0, -1, 1 << 62], np.int64)
    assert simhash.distance(a, np.array([-(1 << 63), 0, -(1 << 63)], np.int64)).tolist() == [1, 64, 2]


def test_links_in_a_hot_bucket(spark):
    rng = np.random.default_rng(3)
    base = 0x0123456789ABCDEF
    fps = {base}
    while len(fps) < 400:  # near copies around one fingerprint, and strangers
        fps.add(base ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    fps |= {int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 200)}
    fps |= {f ^ (1 << 63) for f in list(fps)[:50] if f >= 0}
    fps = sorted({f - (1 << 64) if f >> 63 == 1 else f for f in fps})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = simhash.links(nodes, 4)
    assert found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 4).count() == 0
    got = {r.node: r.label for r in simhash.components(nodes.withColumnRenamed("fp", "node"), found).collect()}
    own = components(fps, 4)
    assert len(set(got.values())) == len(set(own))
    assert all((got[a] == got[b]) == (x == y) for (a, x), (b, y) in itertools.pairwise(zip(fps, own, strict=True)))


def test_drop_near_copies(spark):
    rng = random.Random(9)
    base = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(400)) for _ in range(12)]
    near = [b.replace(b.split()[100], "changed", 1) for b in base]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(base + near + [None, "", None])], "doc_id long, text string, label string")
    kept = near_copies.drop_near_copies(d)
    assert kept.columns == d.columns
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == [*range(12), 24]


def _edited(words_, every, at=0):
    return " ".join(f"new{at}x{i}" if i % every == every // 2 else w for i, w in enumerate(words_))


def test_no_near_copy_of_the_stated_similarity_stays(spark):
    base = [[f"b{b}w{i}" for i in range(360)] for b in range(12)]
    texts = [" ".join(b) for b in base] + [_edited(b, 55, 1) for b in base] + [_edited(b, 30, 2) for b in base]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(0.8 < like(i, i + 12) < 0.85 and like(i, i + 24) < 0.8 and like(i + 12, i + 24) < 0.8 for i in range(12))
    kept = near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r[0] for r in kept.collect()) == [*range(12), *range(24, 36)]


def test_similar_texts_meet_past_a_dissimilar_first_one(spark):
    # one shingle outweighs the rest, so all have one fingerprint; the first is like none of the others
    same = " ".join(["again"] * 120)
    tails = [" ".join(f"t{k}n{i}" for i in range(40)) for k in range(20)]
    texts = [same + " " + tails[0]] + [same + " " + t + end for t in tails[1:] for end in ("", " one more")]
    kept = near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r[0] for r in kept.collect()) == [0, *range(1, 39, 2)]


def test_similarity_is_that_of_all_shingles(spark):
    # a dominant shingle for each pair gives both one fingerprint; a similarity a little above 0.8, or a little below
    rows = []
    for p in range(24):
        n = 72 if p % 2 else 84
        head = [f"top{p}"] * 1200
        common = [f"c{p}w{i}" for i in range(600)]
        rows += [(2 * p + side, " ".join(head + common + [f"s{side}p{p}w{i}" for i in range(n - 4)])) for side in (0, 1)]
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    like = [len(sets[2 * p] & sets[2 * p + 1]) / len(sets[2 * p] | sets[2 * p + 1]) for p in range(24)]
    assert all((0.8 < x < 0.83) if p % 2 else (0.78 < x < 0.8) for p, x in enumerate(like)), like
    kept = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r[0] for r in kept.collect()) == sorted([*range(0, 48, 2), *range(1, 48, 4)])


# 7 ---------------------------------------------------------------------------------------------------------------------


def _graded(spark, n=400):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        toxic, bad = rng.random() < 0.15, rng.random() < 0.15
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["nasty", "vile"])
        if bad:
            t = [x.upper() + "!!" for x in t]
        rows.append((i, " ".join(t)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    d, labels = _graded(spark)
    got = {r.doc_id: r for r in quality.rate_documents(d, labels.where("doc_id % 3 <> 0")).collect()}
    truth = {r.doc_id: r.quality + 1 - r.toxic for r in labels.collect()}
    test = [i for i in truth if i % 3 == 0]
    assert np.mean([got[i].selected == (truth[i] == 2) for i in test]) > 0.9
    assert np.mean([got[i].expected_grade for i in test if truth[i] == 2]) > np.mean([got[i].expected_grade for i in test if truth[i] < 2]) + 0.5


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (10, 0, 1), (10, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.rate_documents(docs, labels).count() == len(rows_of())
    assert quality.select_documents(docs, labels.limit(0)).count() == len(rows_of())
    assert quality.rate_documents(empty, labels).count() == 0


def test_thresholds_stay_ordered():
    rng = np.random.default_rng(0)
    m = quality.fit([rng.integers(0, 50, 5) for _ in range(200)], rng.integers(0, 3, 200))
    assert (np.diff(m.thresholds) >= 0).all()


# 8 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("chunk", [16, 1 << 16])
def test_token_store(docs, chunk):
    store = token_store.write_store(docs, P.path("byte_bpe_50k.json"), 2, chunk=chunk)
    got = sorted((r.start, r.doc_id, r.n_tokens, list(r.ids)) for r in token_store.read_documents(store).collect())
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, want = 0, []
    for i, x in sorted((r[0], r[1] or "") for r in rows_of()):
        own = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((start, i, len(own), own))
        start += len(own)
    assert got == want
    assert store.where(F.col("n_ids") > chunk).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for ids in (np.zeros(0, np.uint32), np.array([0]), rng.integers(0, 50257, 1001), np.array([2**32 - 1, 5])):
        width, planes = token_store.pack_planes(ids)
        assert len(planes) == width and (token_store.unpack_planes(planes, len(ids)) == ids).all()
        assert (token_store.unpack_planes(planes, len(ids), len(ids) // 3, len(ids) // 2) == ids[len(ids) // 3 : len(ids) // 2]).all()


# 9 ---------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets_of([100, 100, 100], [1, 2, 3], 300) == [50, 100, 150]
    t = mixing.targets_of([1000, 10, 10], [1, 2, 3], 1020)
    assert t[1:] == [30, 30] and sum(t) == pytest.approx(1020)
    assert mixing.targets_of([0, 5], [1, 1], 5) == [0, 5] and mixing.targets_of([], [], 0) == []


def test_permutation_and_draws():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, [1, 2]).tolist()) == list(range(n))
    counts = np.array([5, 0, 37, 58])
    shards = [mixing.shard_counts(j, 7, counts, 16, 3) for j in range(7)]
    assert sum(own for own, _ in shards).tolist() == counts.tolist()
    assert all((b == sum((o for o, _ in shards[:j]), np.zeros(4, int))).all() for j, (_, b) in enumerate(shards))


def test_mixing(docs):
    mix = mixing.Mix(docs, block=8, slots=32)
    got = mix.taken().collect()
    again = sorted((r.doc_id, r.taken) for r in mixing.Mix(docs, block=8, slots=32).taken().collect())
    assert again == sorted((r.doc_id, r.taken) for r in got)
    size = {}
    for r in rows_of():
        size[r[2]] = size.get(r[2], 0) + len(words(r[1]))
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(order, mixing.targets_of([size[s] for s in order], [1 + i % 3 for i in range(len(order))], sum(size.values())), strict=True))
    assert len(got) == len(rows_of())
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size
    for s in order:
        assert sum(r.taken for r in got if r.source == s) == pytest.approx(want[s], abs=9)
    # the output's slots are what was counted
    assert mix.pieces().agg(F.sum("words")).first()[0] == sum(r.taken for r in got)


def test_mix_does_not_depend_on_layout(docs):
    mixes = [sorted((r.doc_id, r.taken) for r in mixing.Mix(d, block=8, slots=32, lanes=4).taken().collect()) for d in (docs, docs.repartition(7), docs.coalesce(1).orderBy("text"))]
    assert mixes[0] == mixes[1] == mixes[2]


def test_taken_words_by_hand(docs):
    mix = mixing.Mix(docs, block=8, slots=32, lanes=4)
    stream = {}
    for r in mix.documents.collect():
        stream.setdefault(r.source_ix, []).append((r.offset, r.size, r.rid))
    words_at = {}
    for ix, own in stream.items():
        own.sort()
        flat = [rid for _, size, rid in own for _ in range(size)]
        # documents lie one after another, without gaps
        assert all(flat[o : o + n] == [rid] * n for o, n, rid in own)
        words_at[ix] = flat
    taken, passes = {}, {}
    for r in mix.slots.collect():
        for rid in words_at[r.source_ix][8 * r.block : 8 * r.block + 8]:
            taken[rid] = taken.get(rid, 0) + 1
        passes.setdefault(r.source_ix, []).append(r.block)
    assert {r.rid: r.taken for r in mix.taken().collect() if r.taken} == taken
    for ix, blocks in passes.items():  # passes over a source's blocks: none comes a time more than another but in the last pass
        times = [blocks.count(b) for b in range(-(-len(words_at[ix]) // 8))]
        assert max(times) - min(times) <= 1


def test_mixed_documents(docs, empty):
    out = mixing.mixed_documents(docs, block=8)
    assert out.columns == docs.columns
    assert max(r[0] for r in out.where("doc_id <> 5 and doc_id <> 20").groupBy("doc_id").count().select("count").collect()) <= 3
    assert mixing.mixed_documents(empty).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("radix", [2, 5, 256])
def test_bpe(docs, radix):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    path = P.path("word_bpe_49k.json")
    got = bpe.decode_documents(bpe.encode_documents(docs, path, block_bytes=256, radix=radix), path).collect()
    assert len(got) == len(rows_of())
    text = {r[0]: r[1] or "" for r in rows_of()}
    for r in got:
        own = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, list(r.ids), r.decoded) == (len(own), own, t.decode(own, skip_special_tokens=False))


def test_decode_table(spark):
    d = spark.createDataFrame([(1, [320, 1929], "x"), (2, [], None), (3, None, "y")], "doc_id long, ids array<int>, `a.b` string")
    got = {r.doc_id: r.decoded for r in bpe.decode_documents(d, P.path("word_bpe_49k.json")).collect()}
    assert got == {1: Tokenizer.from_file(P.path("word_bpe_49k.json")).decode([320, 1929], skip_special_tokens=False), 2: "", 3: ""}
    every = spark.range(49408).select(F.array(F.col("id").cast("int")).alias("ids"))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert all(r.decoded == t.id_to_token(r.ids[0]) for r in bpe.decode_documents(every, P.path("word_bpe_49k.json")).collect())


# the exchange ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("n", "radix"), [(1, 256), (7, 2), (30, 3), (300, 256)])
def test_items_of_all_blocks_meet_once(spark, n, radix):
    import pyarrow as pa

    answered = spark.sparkContext.accumulator(0)

    def answer(items):
        answered.add(items.num_rows)
        return pa.table({"said": pa.array([w + "!" for w in items.column("w").to_pylist()])}), str(items.num_rows).encode()

    meeting = exchange.Meeting(n, exchange.word_key(), bpe.merged_words, answer, radix=radix)
    assert meeting.radix <= radix and meeting.radix**meeting.levels >= n
    own = lambda block: pa.table({"w": pa.array([f"w{(block * 7 + i) % 50}" for i in range(block % 9)] + ["all"] * (block % 3 > 0), pa.large_string())})

    def ask(group):
        block = group.column("block")[0].as_py()
        return meeting.ask(own(block), block)

    def check(group, found):
        block = group.column("block")[0].as_py()
        items = own(block)
        told = meeting.told(items, found)
        right = told is None if not items.num_rows else told.column("said").to_pylist() == [w + "!" for w in items.column("w").to_pylist()]
        return pa.table({"block": [block], "right": [right]})

    blocks = spark.range(n).select(F.col("id").alias("block"))
    asked = blocks.groupBy("block").applyInArrow(ask, exchange.ASKED)
    assert asked.count() <= n * meeting.radix
    found = meeting.meet(asked).persist()
    distinct = {w for k in range(n) for w in own(k).column("w").to_pylist()}
    assert sum(int(r.found) for r in found.where(F.col("to_path") == exchange.REMARKS).collect()) == len(distinct)
    assert answered.value == len(distinct)
    got = blocks.groupBy("block").cogroup(found.where("to_path >= 0").groupBy("to_grp")).applyInArrow(check, "block bigint, right boolean").collect()
    found.unpersist()
    assert len(got) == n and all(r.right for r in got)


# layouts, null ids, long texts -----------------------------------------------------------------------------------------

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
RUNS = {
    "exact": lambda d: exact_dedup.exact_groups(d).select("doc_id", "keep_id", "group_size", "text_sha256"),
    "spans": lambda d: suffix_dedup.repeated_spans(d, block_bytes=1 << 10).select("doc_id", "n_bytes", "kept"),
    "lines": lambda d: line_dedup.drop_common_lines(d).select("doc_id", "n_lines", "n_removed", "kept"),
    "winnowing": lambda d: fingerprints.edited_and_next(d, range_rows=10),
    "simhash": lambda d: simhash.near_groups(d).select("doc_id", "fingerprint", "component_id"),
    "near": lambda d: near_copies.drop_near_copies(d).select("doc_id", "text"),
    "store": lambda d: token_store.read_documents(token_store.write_store(d, BYTES, 2)).select("doc_id", "start", "n_tokens", "ids"),
    "mix": lambda d: mixing.Mix(d, block=8, slots=32, lanes=4).taken().select("doc_id", "size", "taken"),
    "bpe": lambda d: bpe.decode_documents(bpe.encode_documents(d, WORDS, block_bytes=256), WORDS).select("doc_id", "ids", "decoded"),
    "words": lambda d: lm_scoring.score_documents(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score")),
}


@pytest.mark.parametrize("name", RUNS)
def test_layouts_agree(docs, name):
    one, two = (sorted(map(repr, RUNS[name](d).collect())) for d in (docs, docs.coalesce(1).orderBy(F.xxhash64("text")).repartition(7)))
    assert one == two and len(one) > 40


@pytest.mark.parametrize("name", RUNS)
def test_null_ids(spark, name):
    t = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(6)]
    rows_ = [(None, t[0], "a"), (None, t[1], "a"), (None, t[0], None), (None, None, "b"), (3, t[0], "a"), (4, t[2], "b"), (5, "", "b"), (None, t[1] + " end", "a")]
    got = RUNS[name](spark.createDataFrame(rows_, "doc_id long, text string, source string")).collect()
    ids_ = [r.doc_id for r in got]
    if name == "near":  # null is last, so 3 stays of its group; of two null ones the first seen; of null and empty texts the empty one with an id
        assert sorted(x for x in ids_ if x is not None) == [3, 4, 5] and ids_.count(None) == 1
        return
    assert sorted((x is None, x or 0) for x in ids_) == [(False, 3), (False, 4), (False, 5)] + [(True, 0)] * 5
    if name == "spans":  # null is later than any id, and null ids are not earlier than one another
        assert sorted((r.doc_id or 0, len(r.kept)) for r in got)[-3:] == [(3, len(t[0])), (4, len(t[2])), (5, 0)] and [len(r.kept) for r in got if r.doc_id is None and r.n_bytes == len(t[0])] != []
    if name == "store":
        assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [3, 4, 5] + [None] * 5
    if name == "words":
        assert all(r.held_out == (zlib.crc32(b"null") % 10 == 0) for r in got if r.doc_id is None)


def test_long_texts(spark):
    rng = random.Random(11)
    long = " ".join(f"{rng.choice(['an', 'other', 'thing', 'Ünter', 'que'])}{rng.randint(0, 9999)}" for _ in range(60_000))
    rows_ = [(1, long, "a"), (2, "short text", "a"), (3, "x " + long[: len(long) // 2], "b"), (4, long.replace("thing", "think", 1), "b")]
    d = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(2)
    text = {i: t for i, t, _ in rows_}
    t = Tokenizer.from_file(WORDS)
    for r in RUNS["bpe"](d).collect():
        own = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == own and r.decoded == t.decode(own, skip_special_tokens=False)
    t = Tokenizer.from_file(BYTES)
    for r in RUNS["store"](d).collect():
        assert list(r.ids) == [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
    assert {r.doc_id: r.fingerprint for r in RUNS["simhash"](d).collect()} == {i: f"{simhash_of(x):016x}" for i, x in text.items()}
    assert sorted(r.doc_id for r in RUNS["near"](d).collect()) == [1, 2, 3]
    kept = {r.doc_id: bytes(r.kept).decode() for r in RUNS["spans"](d).collect()}
    assert kept[1] == long and kept[2] == "short text" and kept[3] == "x " and kept[4] == "k"
    assert {r.doc_id: r.size for r in RUNS["mix"](d).collect()} == {i: len(words(x)) for i, x in text.items()}
    assert {r.doc_id: r.n_tokens for r in RUNS["words"](d).collect()} == {i: len(words(x)) + 1 for i, x in text.items()}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in RUNS["exact"](d).collect()} == {i: (i, 1) for i in text}
    assert {r.doc_id: r.n_removed for r in RUNS["lines"](d).collect()} == dict.fromkeys(text, 0)
    assert {r.doc_id: r.fingerprint for r in RUNS["winnowing"](d).collect()} == {i: " ".join(f"{p}:{h & (1 << 64) - 1:x}" for h, p in winnowed(x)) for i, x in text.items()}


def test_packing_holds_rows_once():
    texts = [f"{i} " + "x" * 1000 for i in range(3000)]
    held = [pa.RecordBatch.from_arrays([pa.array([t]), pa.array([i % 4], pa.int64())], names=["text", "__block"]) for i, t in enumerate(texts)]
    before, size = pa.total_allocated_bytes(), sum(b.nbytes for b in held)
    rows = shared.payloads(held)
    first = next(rows)
    # the rows in one piece, and no more of those that came in
    assert not held and pa.total_allocated_bytes() - before < size / 2
    got = {b.column(0)[0].as_py(): shared.from_payload(b.column(1)[0].as_py()).column("text").to_pylist() for b in [first, *rows]}
    assert got == {k: texts[k::4] for k in range(4)}


def test_blocks_hold_what_was_put_in(docs):
    blocks = shared.packed_blocks(docs.select("doc_id", "text"), 5, "doc_id", "text", flush_bytes=1 << 10)
    assert blocks.count() > 10
    got = blocks.groupBy("block").applyInArrow(lambda g: shared.unpacked(g), "doc_id long, text string")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.select("doc_id", "text").collect()))


# the classifier's scores -----------------------------------------------------------------------------------------------


def _places(text):
    t = text or ""
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    found = [w for w in words(t.translate({ord(c): " " for c in marks}).lower())]
    places = {h64(w) % quality.PLACES for w in found}
    n, count = max(len(t), 1), max(len(found), 1)
    share = lambda chars: sum(c in chars for c in t) / n
    style = [share("!#$%&*+/<=>?@[\\]^_{|}~"), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), 4 * share("|"), len(places) / count, min(n / count, 40.0) / 40.0]
    return sorted(places | {quality.PLACES + i * (quality.STEPS + 1) + min(math.floor(s * quality.STEPS), quality.STEPS) for i, s in enumerate(style)})


def test_quality_scores_by_hand(docs):
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(0, 0.05, quality.SIZE), np.array([-0.4, 0.7]))
    got = quality.score(docs, model, cut=0.45).select("row.doc_id", "expected_grade", "tail", "selected").collect()
    text = {r[0]: r[1] for r in rows_of()}
    assert len(got) == len(rows_of())
    for r in got:
        s = model.weights.astype(np.float32)[_places(text[r.doc_id])].astype(float).sum()
        tails = 1 / (1 + np.exp(model.thresholds - s))
        assert (r.expected_grade, r.tail) == (pytest.approx(tails.sum(), abs=1e-4), pytest.approx(tails[-1], abs=1e-4))
        assert r.selected == (r.tail >= 0.45)


# empty tables ----------------------------------------------------------------------------------------------------------


def test_empty_tables(empty):
    path = P.path("byte_bpe_50k.json")
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0
    assert suffix_dedup.repeated_spans(empty).count() == 0
    assert line_dedup.drop_common_lines(empty).count() == 0
    assert fingerprints.edited_and_next(empty).count() == 0
    assert simhash.near_groups(empty).count() == 0 and near_copies.drop_near_copies(empty).count() == 0
    assert token_store.read_documents(token_store.write_store(empty, path, 2)).count() == 0
    assert mixing.Mix(empty).taken().count() == 0
    assert bpe.encode_documents(empty, P.path("word_bpe_49k.json")).count() == 0
    assert lm_scoring.score_documents(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
