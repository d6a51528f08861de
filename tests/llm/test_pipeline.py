"""The pipeline's stages on the smallest tables, each against a brute-force version of what it should do to its own input."""

import hashlib
import os
import re
from collections import Counter

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ploidia.llm import quality
from ploidia.llm.shared import staged

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, f in cp.STAGES:
        out.append(staged(f(spark, out[-1], DATA), f"test-{name}"))
    return out


def rows(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def shingles(t):
    w = WORD.findall(t.translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rated = {r.doc_id for r in quality.rate_documents(stages[0], labels).collect() if r.selected}
    assert sorted(i for i, _ in rows(stages[1])) == sorted(rated)
    clean = {r.doc_id for r in labels.where("quality = 1 and toxic = 0").collect()}
    assert len(clean & rated) > 0.95 * len(clean)


def test_exact(stages):
    best = {}
    for i, t in rows(stages[1]):
        best[t.translate(LOW)] = max(best.get(t.translate(LOW), -1), i)
    assert sorted(i for i, _ in rows(stages[2])) == sorted(best.values())


def test_near(stages):
    """Of each component of pairs with a similarity of 0.8 or more, the document with the smallest id stays; nothing else goes."""
    before, after = dict(rows(stages[2])), dict(rows(stages[3]))
    sets = {i: shingles(t) for i, t in before.items()}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in before:
        for b in before:
            if a < b and like(a, b) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in before}


def test_mix(stages):
    before, after = dict(rows(stages[3])), Counter(i for i, _ in rows(stages[4]))
    assert set(after) <= set(before) and max(after.values()) <= 3
    size = lambda i: len(WORD.findall(before[i]))
    assert sum(size(i) * n for i, n in after.items()) == pytest.approx(sum(map(size, before)), rel=0.15)


def test_encode(spark, stages):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    text = dict(rows(stages[4]))
    got = stages[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows(stages[4]))
    for r in got:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_agrees(spark, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in cp.run(spark, DATA).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[5].collect())
