"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating's grade is quality + 1 - toxic: 0, 1 or 2, where 2 is a good and clean
text. All thresholds share one weight vector over hashed features, and
P(grade > j) = sigmoid(x.w - threshold j). The expected grade is the sum of
these tails, and a document is selected if the tail above the last threshold
reaches ``cut``.

Features are presences, so that one insult counts as much in a long text as in a
short one: lower-cased words without the marks around them, hashed into 2^18
places, and a few marks of style in steps (share of symbols, of capitals, of
digits, of distinct words, of table bars). The fit is per-coordinate proximal
gradient descent with an L1 penalty, which leaves only words that tell grades
apart. It reads a bounded sample of the rated documents (``sample``, by hash of
doc_id); every document is scored on its whole text in one pass, with the weight
vector, of fixed size, in each task.

Defined results: null text counts as empty; unrated documents are scored like
others; ratings with a null id or grade are left out, repeated ratings of one
document count by their mean grade, rounded; without ratings every tail is 1;
rows are never joined back by id, so repeated and null ids keep their rows and
other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, small_batches, tidy

PLACES = 1 << 18
SAMPLE = 20_000
GRADES = 3
#: Steps of the marks of style.
STEPS = 20


def features(text):
    """Array of distinct feature places of a text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.char_length(t), F.lit(1)).cast("double")
    # ASCII marks are dropped around and inside words, so that "word," and "word" are one
    words = F.array_remove(F.split(F.lower(F.translate(t, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", " " * 32)), SPACE), "")
    places = F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PLACES)).cast("int")))
    symbols = F.char_length(t) - F.char_length(F.translate(t, "!#$%&*+/<=>?@[\\]^_{|}~", ""))
    capitals = F.char_length(t) - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    digits = F.char_length(t) - F.char_length(F.translate(t, "0123456789", ""))
    bars = F.char_length(t) - F.char_length(F.translate(t, "|", ""))
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    shares = [symbols / n, capitals / n, digits / n, F.lit(4.0) * bars / n, F.size(places) / count, F.least(n / count, F.lit(40.0)) / F.lit(40.0)]
    style = [(F.lit(PLACES + i * (STEPS + 1)) + F.least(F.floor(s * STEPS), F.lit(STEPS))).cast("int") for i, s in enumerate(shares)]
    return F.concat(F.array(*style), places)


SIZE = PLACES + 6 * (STEPS + 1)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, flat: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        """P(grade > j) of each row, j ascending."""
        score = np.zeros(len(n))
        if len(flat):
            full = n > 0
            score[full] = np.add.reduceat(self.weights[flat], starts[full])
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 4, rate: float = 0.15, l1: float = 1.0, l2: float = 1e-3, seed: int = 5) -> Model:
    """Proximal per-coordinate descent on the cumulative-link likelihood; thresholds stay in order."""
    z, total = np.zeros(SIZE), np.zeros(SIZE)
    w = np.zeros(SIZE)
    theta = np.array([np.log((np.sum(grades <= j) + 1) / (np.sum(grades > j) + 1)) for j in range(GRADES - 1)], float)
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(len(theta)))
    g2 = np.full(len(theta), 1.0)
    rng = np.random.default_rng(seed)
    sig = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i], grades[i]
            s = w[x].sum()
            up = sig(theta - s)  # P(grade <= j)
            hi = up[y] if y < len(theta) else 1.0
            lo = up[y - 1] if y > 0 else 0.0
            p = max(hi - lo, 1e-9)
            d_hi = hi * (1 - hi) if y < len(theta) else 0.0
            d_lo = lo * (1 - lo) if y > 0 else 0.0
            g = (d_hi - d_lo) / p  # d(-log p) / d score
            # weights: follow the regularised leader
            old = total[x]
            new = old + g * g
            z[x] += g - (np.sqrt(new) - np.sqrt(old)) / rate * w[x]
            total[x] = new
            zx = z[x]
            w[x] = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((1.0 + np.sqrt(new)) / rate + l2))
            for j, d in ((y, -d_hi / p), (y - 1, d_lo / p)):
                if 0 <= j < len(theta):
                    g2[j] += d * d
                    theta[j] -= rate * d / np.sqrt(g2[j])
            theta = np.maximum.accumulate(theta)
    return Model(w, theta)


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, grade of rated documents, one row each."""
    rated = labels.select(F.col(f"`{id_col}`").alias("doc_id"), (F.col("quality") + 1 - F.col("toxic")).alias("grade")).where("doc_id is not null and grade is not null")
    return rated.groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, **how) -> Model | None:
    """Fits on at most about ``sample`` rated documents, chosen by hash of their id."""
    rated = graded(labels)
    n = rated.count()
    share = min(1.0, sample / max(n, 1))
    chosen = rated.where(F.pmod(F.xxhash64(F.lit(71), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rated
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "doc_id").select("doc_id", F.array_sort(features(F.col("text"))).alias("x"), "grade")
    table = read.toArrow()
    if table.num_rows == 0:
        return None
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")]))
    x = table.column("x").combine_chunks()
    flat, at = x.values.to_numpy(), x.offsets.to_numpy()
    model = fit([flat[s:e] for s, e in zip(at[:-1], at[1:], strict=True)], table.column("grade").to_numpy(), **how)
    del table, x, flat, at
    tidy()
    return model


def score(docs: DataFrame, model: Model | None, text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """``docs`` in a column ``row`` (struct), with ``expected_grade``, ``tail`` and ``selected``."""
    if model is None:
        model = Model(np.zeros(SIZE), np.full(GRADES - 1, -np.inf))
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    @F.arrow_udf("array<double>")
    def tails(x: pa.Array) -> pa.Array:
        tidy()
        weights, thresholds = held.value
        at = x.offsets.to_numpy().astype(np.int64)
        t = Model(weights, thresholds).tails(x.values.to_numpy()[at[0] : at[-1]], at[:-1] - at[0], np.diff(at))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * t.shape[1]), pa.array(t.ravel()))

    # only the places of features go to Python; texts stay
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tails(features(F.col(f"`{text_col}`"))).alias("t"))
    return inner.select("row", F.aggregate("t", F.lit(0.0), lambda a, b: a + b).alias("expected_grade"), F.element_at("t", -1).alias("tail"), (F.element_at("t", -1) >= cut).alias("selected"))


def rate_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, **how) -> DataFrame:
    """doc_id, expected_grade, tail, selected."""
    return score(docs, train(docs, labels, id_col, text_col, **how), text_col, cut).select(F.col(f"row.`{id_col}`").alias("doc_id"), "expected_grade", "tail", "selected")


def select_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` that are selected, unchanged."""
    return score(docs, train(docs, labels, id_col, text_col, **how), text_col, cut).where("selected").select("row.*")
