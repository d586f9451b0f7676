"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled set is web text of unknown quality, drawn from all documents of the
training folds. Labels of the other class are never used. A linear scorer over shape features of the text minimises the
non-negative unbiased risk

    prior * E_pos[l(+g)] + max(0, E_unl[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss. The class prior is estimated first: plain positive-against-unlabelled scorers rank the rows they have not seen,
and prior = min over score cuts of P_unl(score >= cut) / P_pos(score >= cut), with a margin for sample size.

Fitting uses at most `fit_rows` positives and `fit_rows` unlabelled documents, those with the smallest hash of their id (documented
bound); scoring is one expression over the text, without shuffle or join.

Nulls: a null text counts as empty and gets the score of the empty text. Labels with a null id or null quality are ignored; an id with
contradicting labels is not trusted. Without positives nothing can be learned and nothing is rejected: all scores are `cut`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, crc_fold

CUT = 0.7
FIT_ROWS = 6000
MARKS = b"!?.,;:|*$&%#@-_=+/\\<>()[]{}\"'"

_upper = np.zeros(256, bool)
_upper[65:91] = True
_lower = np.zeros(256, bool)
_lower[97:123] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
_high = np.arange(256) >= 128


def shape_features(text: str | None) -> list[float]:
    """Shares of byte classes and marks, and how repetitive words, neighbours and lines are. Scale-free but for one length term."""
    data = (text or "").encode()
    words = data.split()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, k = max(1, len(data)), max(1, len(words))
    letters = max(1, int(counts[_upper].sum() + counts[_lower].sum() + counts[_high].sum()))
    lines = [line for line in data.split(b"\n") if line.strip()]
    distinct = len(set(words))
    adjacent = sum(map(bytes.__eq__, words, words[1:])) / k
    pairs = len(set(zip(words, words[1:])))
    longest = max(map(len, words), default=0)
    out = [
        counts[_upper].sum() / letters, counts[_digit].sum() / n, counts[_high].sum() / n, counts[10] / n, counts[32] / n,
        np.log1p(len(words)), len(data) / k / 10, min(longest, 1000) / 100, distinct / k, distinct / (k**0.7 + 1), adjacent,
        pairs / max(1, len(words) - 1), len(set(lines)) / max(1, len(lines)), min(1.0, len(lines) / k), np.log1p(10 * adjacent), float(not words),
    ]
    marks = counts[list(MARKS)] / k
    return [*map(float, out), *np.sqrt(marks).tolist()]


def feature_matrix(texts) -> np.ndarray:
    rows = [shape_features(t) for t in texts]
    return np.array(rows, np.float64) if rows else np.empty((0, 16 + len(MARKS)))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class PuModel:
    """Standardised linear scorer; `prior` is the estimated share of positives."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean) / self.scale, -8, 8)
        return _sigmoid(z @ self.weights[:-1] + self.weights[-1])


def _descend(positive, unlabelled, prior, steps, rate, decay, non_negative, seed=5):
    """Adam on minibatches. With `non_negative` the PU risk, else the plain risk of positives against unlabelled rows."""
    draw = np.random.default_rng(seed)
    p, u = np.c_[positive, np.ones(len(positive))], np.c_[unlabelled, np.ones(len(unlabelled))]
    w, first, second = np.zeros(p.shape[1]), 0.0, 0.0
    for step in range(1, steps + 1):
        a, b = p[draw.integers(0, len(p), 256)], u[draw.integers(0, len(u), 512)]
        sa, sb = _sigmoid(a @ w), _sigmoid(b @ w)
        up_pos = -(a * (1 - sa)[:, None]).mean(0)  # d/dw of E_pos[l(+g)]
        down_pos = (a * sa[:, None]).mean(0)  # d/dw of E_pos[l(-g)]
        down_unl = (b * sb[:, None]).mean(0)
        if non_negative:
            negative = -np.log(np.maximum(1 - sb, 1e-12)).mean() + prior * np.log(np.maximum(1 - sa, 1e-12)).mean()
            grad = prior * up_pos + (down_unl - prior * down_pos) if negative >= 0 else prior * down_pos - down_unl
        else:
            grad = up_pos + down_unl
        grad = grad + decay * np.r_[w[:-1], 0.0]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(pos_scores: np.ndarray, unl_scores: np.ndarray) -> float:
    """Smallest ratio of the shares above a cut, each ratio raised by its sampling margin; in [0.05, 0.99]."""
    cuts = np.quantile(pos_scores, np.linspace(0.0, 0.9, 46))
    above_p = np.array([(pos_scores >= c).mean() for c in cuts])
    above_u = np.array([(unl_scores >= c).mean() for c in cuts])
    margin = np.sqrt(above_u * (1 - above_u) / len(unl_scores)) + np.sqrt(above_p * (1 - above_p) / len(pos_scores)) + 1 / len(unl_scores)
    best = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.99))


def fit_arrays(positive: np.ndarray, unlabelled: np.ndarray) -> PuModel:
    """Fit on feature rows: each fifth is ranked by the rest, which gives the prior; then all rows fit the PU risk."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    prior = 0.5
    if len(p) >= 20 and len(u) >= 20:
        seen = []
        for k in range(5):
            here, there = np.arange(len(p)) % 5 == k, np.arange(len(u)) % 5 == k
            w = _descend(p[~here], u[~there], None, 1000, 0.02, 1e-3, False, seed=k)
            seen.append((p[here] @ w[:-1] + w[-1], u[there] @ w[:-1] + w[-1]))
        prior = estimate_prior(*(np.concatenate(x) for x in zip(*seen)))
    weights = _descend(p, u, prior, 4000, 0.02, 1e-4, True)
    return PuModel(mean, scale, weights, prior)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> PuModel | None:
    """Learn from the ids of the training folds (crc32 of the id mod 4 is not 2); None without positives or texts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    trusted = known.where((F.col("q") == 1) & (crc_fold(F.col("doc_id"), 4) != 2)).select("doc_id")
    ids = docs.select("doc_id", "text").where(crc_fold(F.col("doc_id"), 4) != 2)
    # twice as many positives as needed: not every labelled id has a document
    positive = ids.join(F.broadcast(bounded_rows(trusted, F.col("doc_id"), 2 * fit_rows)), "doc_id")
    sample = ids.where("doc_id is not null").select("doc_id").distinct()
    unlabelled = ids.join(F.broadcast(bounded_rows(sample, F.col("doc_id"), fit_rows)), "doc_id")

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "f": list(feature_matrix(batch["text"]))})

    def features(rows, most):  # an id may have any number of rows: rows are bounded once more
        found = rows.select("doc_id", "text").mapInPandas(run, "doc_id long, f array<double>")
        return np.array(bounded_rows(found, F.col("doc_id"), most).toPandas()["f"].tolist())

    p, u = features(positive, 2 * fit_rows), features(unlabelled, fit_rows)
    return fit_arrays(p, u) if len(p) and len(u) else None


def score_column(model: PuModel | None, text: Column, cut: float = CUT) -> Column:
    if model is None:
        return F.lit(cut)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_matrix(texts)), dtype="float64")

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, cut: float = CUT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs` (doc_id, text)."""
    model = fit_quality(docs, labels, fit_rows)
    scored = docs.select(F.col("doc_id"), score_column(model, docs["text"], cut).alias("score"))
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = CUT, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of `docs` that are not rejected."""
    return docs.where(score_column(fit_quality(docs, labels, fit_rows), docs["text"], cut) >= cut)
