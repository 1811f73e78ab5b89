"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled rows of quality 1, unlabelled ones are web texts whose labels, if any, aren't looked
at. With class prior p and a score f, the risk is p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]): what unlabelled
texts cost as negatives, less what the positives among them do, but never below zero (Kiryo et al., 2017). f is linear in
standardised features of the text and their squares, l the logistic loss, so sigmoid(f) is the score.

The prior is estimated from positives and unlabelled texts, too (Elkan and Noto, 2008): the unlabelled texts' mean score over the
positives' mean score, of a classifier of positives against unlabelled. Labels of 0 are read nowhere.

Fitting takes at most FIT_ROWS positives and as many unlabelled texts, those of the smallest hashed ids, one row of each id;
their features go to the driver, 24 numbers each. Scoring is one pass over the whole texts without a shuffle.

Defined cases: a null, empty or blank text has all features zero and is scored by them; with no positives at all the
score is 0.5 everywhere; repeated rows get equal scores; of rows that share an id the one with the least features is learned from, and
rows without an id never are; other columns may have any names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunder.llm.common import held_out, small_batches

FIT_ROWS, THRESHOLD = 10_000, 0.3
FEATURES = 24


def features(text: str | None) -> np.ndarray:
    """Shares of bytes and words of several kinds in the whole text, and how often it repeats itself."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.zeros(FEATURES)
    n, k = len(data), len(words)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lower, upper, digits, wide = h[97:123].sum(), h[65:91].sum(), h[48:58].sum(), h[128:].sum()
    space, dot, comma, shout = h[32] + h[9:14].sum(), h[46], h[44], h[33] + h[63]
    symbols = n - lower - upper - digits - wide - space - dot - comma - shout - h[39] - h[34] - h[45]
    counts = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    sizes = np.fromiter(map(len, words), np.int64, k)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    return np.array(
        [
            np.log1p(n) / 10, np.log1p(k) / 10, symbols / n, upper / max(lower + upper + wide, 1), digits / n, wide / n, space / n, dot / n, comma / n, shout / n, h[124] / n,
            sizes.mean() / 10, sizes.std() / 10, (sizes <= 3).mean(), (sizes > 14).mean(), len(counts) / k, np.log1p(k) / 10 * len(counts) / k, max(counts.values()) / k,
            again / k, len(set(lines)) / len(lines), 1 - pairs / max(k - 1, 1), (h[47] + h[60] + h[62] + h[92]) / n, h[10] / n, min(n, 100) / 100,
        ]
    )


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def quality_features(texts: pa.Array) -> pa.Array:
        return pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return quality_features(text)


class Model:
    def __init__(self, centre: np.ndarray, spread: np.ndarray, weights: np.ndarray, prior: float):
        self.centre, self.spread, self.weights, self.prior = centre, spread, weights, prior

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -5, 5)
        return np.concatenate([np.ones((len(x), 1)), z, z * z / 5], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(x) @ self.weights)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def minimise(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk; where its second part falls below zero, the step raises it instead."""
    both = np.concatenate([xp, xu])
    model = Model(both.mean(0), both.std(0) + 1e-3, np.zeros(1 + 2 * both.shape[1]), prior)
    p, u = model.inputs(xp), model.inputs(xu)
    w, m, v = model.weights, np.zeros_like(model.weights), np.zeros_like(model.weights)
    w[0] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        _, g = risk(w, p, u, prior)
        g = g + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return model


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of weights w over inputs of positives and unlabelled, and the step's direction: its slope, or if the second part is below zero, what raises that."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    own = -prior * np.log(np.maximum(sp, 1e-12)).mean()
    rest = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
    as_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    return own + max(0.0, rest), prior * (p.T @ (sp - 1)) / len(p) + as_negative if rest >= 0 else -as_negative


def class_prior(xp: np.ndarray, xu: np.ndarray) -> float:
    """The share of positives among the unlabelled."""
    share = len(xp) / (len(xp) + len(xu))
    known = minimise(xp, np.concatenate([xp, xu]), share)  # at this prior the risk is that of plain logistic regression
    return min(max(float(known.score(xu).mean() / max(known.score(xp).mean(), 1e-6)), 0.05), 0.98)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> Model | None:
    """None without a positive. Of the labels, those of held-out rows aren't read."""
    small_batches(docs.sparkSession)
    known = labels.where(~held_out(F.col(doc_id)) & (F.col(label).cast("int") == 1)).select(F.col(doc_id).alias("_id"))
    few = lambda ids: ids.orderBy(F.xxhash64("_id"), "_id").limit(rows)  # noqa: E731  a bounded sample, the same in any order of rows
    positive = few(known.distinct())
    unlabelled = few(docs.where(~held_out(F.col(doc_id))).select(F.col(doc_id).alias("_id")).distinct())
    chosen = positive.withColumn("p", F.lit(1)).union(unlabelled.withColumn("p", F.lit(0))).groupBy("_id").agg(F.max("p").alias("p"), F.min("p").alias("u"))
    some = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # 2 * rows ids at most
    got = some.select("_id", "p", "u", feature_column(F.col("_text")).alias("x")).groupBy("_id", "p", "u").agg(F.min("x").alias("x")).toArrow()  # ids may repeat
    if not len(got):
        return None
    x = got["x"].combine_chunks().values.to_numpy().reshape(-1, FEATURES)
    p, u = got["p"].to_numpy() == 1, got["u"].to_numpy() == 0
    order = np.lexsort(x.T)  # sums in one order, so that the model doesn't depend on how tasks end
    x, p, u = x[order], p[order], u[order]
    if not p.any() or not u.any():
        return None
    return minimise(x[p], x[u], class_prior(x[p], x[u]))


def score(text: Column, model: Model | None) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def quality_score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([features(t.as_py()) for t in texts]).reshape(-1, FEATURES)), pa.float64())

    return quality_score(text)


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = fit(docs, labels, doc_id, text, label, **how)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
