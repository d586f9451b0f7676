"""Toxicity by a classifier chain.

Categories are predicted one after another; each later linear model also sees the probabilities of the earlier ones. While fitting,
those come from models that have not seen the row (out-of-fold), so later models learn from probabilities as good as they will get.
Categories are label expressions in chain order; the default chain over the labels (quality, toxic) is

    junk (quality 0)  ->  toxic  ->  severe (toxic and quality 0)

Features are presences and log counts of a vocabulary chosen from the labelled training documents: words are counted by document and
category over all of them in Spark, and the `vocabulary` words with the largest log-likelihood ratio for any category are kept,
plus shares of capitals, marks and repeated words. Models are L2 logistic regressions, fitted in numpy on at most `fit_rows`
labelled rows with the smallest hash of their id (documented bound). Scoring is one expression over the text.

Nulls: a null text counts as empty; labels with a null id or a null category are not used. A category with fewer than two classes in
the training rows gets its constant rate. With no training rows at all every probability is 0. Repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_rows, crc_fold, store
from .quality import feature_matrix

CATEGORIES = {"junk": "quality = 0", "toxic": "toxic = 1", "severe": "toxic = 1 and quality = 0"}
FIT_ROWS, VOCABULARY, FOLDS = 12_000, 400, 5
LETTERS = bytes(c if bytes([c]).isalnum() or c >= 128 else 32 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case letter-digit words (A-Z lowered; other bytes of UTF-8 count as letters)."""
    return text.encode().lower().translate(LETTERS).split() if text else []


def _logistic(x: np.ndarray, y: np.ndarray, decay: float, steps: int = 60) -> np.ndarray:
    """L2 logistic regression by limited-memory quasi-Newton steps on standardised rows (last column: bias, not penalised)."""
    n, d = x.shape
    penalty = np.r_[np.full(d - 1, decay), 0.0]

    def risk(w):
        z = (x @ w.astype(x.dtype)).astype(np.float64)  # rows may be 32-bit, sums are not
        value = np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * w * w).sum()
        return value, (0.5 * (1 + np.tanh(0.5 * z)) - y).astype(x.dtype) @ x + penalty * w

    w = np.zeros(d)
    value, grad = risk(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, stack = grad.copy(), []
        for s, g in reversed(moves):
            a = (s @ direction) / (s @ g)
            stack.append(a)
            direction -= a * g
        if moves:
            s, g = moves[-1]
            direction *= (s @ g) / (g @ g)
        for (s, g), a in zip(moves, reversed(stack)):
            direction += s * (a - (g @ direction) / (s @ g))
        rate = 1.0 if moves else 1.0 / max(1.0, np.abs(grad).sum())
        while rate > 1e-10:
            new = w - rate * direction
            new_value, new_grad = risk(new)
            if new_value <= value - 1e-4 * rate * (grad @ direction):
                break
            rate /= 2
        else:
            break
        if (new - w) @ (new_grad - grad) > 1e-12:
            moves = [*moves[-9:], (new - w, new_grad - grad)]
        done = value - new_value < 1e-7 * max(1.0, abs(value))
        w, value, grad = new, new_value, new_grad
        if done:
            break
    return w


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Chain:
    """Fitted chain: words of the vocabulary and, for each category, weights over (bias last) features and earlier probabilities."""

    words: list[bytes]
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    models: dict[str, np.ndarray | float] = field(default_factory=dict)

    def features(self, texts) -> np.ndarray:
        index = {w: k for k, w in enumerate(self.words)}
        out = np.zeros((len(texts), 2 * len(self.words)))
        for i, text in enumerate(texts):
            counts: dict[int, int] = {}
            for k in filter(None.__ne__, map(index.get, plain_words(text))):
                counts[k] = counts.get(k, 0) + 1
            for k, c in counts.items():
                out[i, 2 * k], out[i, 2 * k + 1] = 1.0, np.log1p(c)
        return np.hstack([out, feature_matrix(texts)])

    def probabilities(self, features: np.ndarray) -> dict[str, np.ndarray]:
        out: dict[str, np.ndarray] = {}
        z = np.clip((features - self.mean) / self.scale, -6, 6) if self.mean is not None else features
        for name, w in self.models.items():
            if isinstance(w, float):
                out[name] = np.full(len(features), w)
            else:
                out[name] = _sigmoid(np.column_stack([z, *out.values(), np.ones(len(z))]) @ w)
        return out


def fit_arrays(words: list[bytes], features: np.ndarray, targets: dict[str, np.ndarray], folds: np.ndarray, decay: float = 3.0) -> Chain:
    mean, scale = features.mean(0, dtype=np.float64), features.std(0, dtype=np.float64) + 0.02
    z = np.clip((features - mean) / scale, -6, 6).astype(features.dtype)
    chain, earlier = Chain(words, mean, scale), []
    for name, y in targets.items():
        y = y.astype(float)
        x = np.column_stack([z, *(p.astype(z.dtype) for p in earlier), np.ones(len(z), z.dtype)])
        if len(set(y.tolist())) < 2:
            chain.models[name] = float(y.mean())
            earlier.append(np.full(len(z), y.mean()))
            continue
        unseen = np.zeros(len(z))
        for k in np.unique(folds):
            own = folds == k
            kept = y[~own]
            unseen[own] = _sigmoid(x[own] @ _logistic(x[~own], kept, decay)) if 0 < kept.sum() < len(kept) else kept.mean() if len(kept) else 0.0
        chain.models[name] = _logistic(x, y, decay)
        earlier.append(unseen)
    return chain


def choose_words(docs: DataFrame, categories: list[str], vocabulary: int) -> list[bytes]:
    """The words whose document counts depart most from each category's rate; `docs` has text and 0/1 category columns.

    The texts are read once: their word counts are stored, and every category ranks the stored counts.
    """
    total = docs.drop("text").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in categories)).first()
    if not total["n"]:
        return []

    def run(batches):
        for batch in batches:
            rows: dict[bytes, np.ndarray] = {}
            flags = batch[categories].to_numpy(np.int64)
            for text, y in zip(batch["text"], flags):
                one = np.r_[1, y]
                for w in set(plain_words(text)):
                    rows[w] = rows[w] + one if w in rows else one
            if rows:
                yield pd.DataFrame({"w": list(rows), "n": [r[0] for r in rows.values()], **{c: [r[k + 1] for r in rows.values()] for k, c in enumerate(categories)}})

    counted = docs.select("text", *categories).mapInPandas(run, "w binary, n long, " + ", ".join(f"{c} long" for c in categories))
    sums = store(counted.groupBy("w").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in categories)).where("n >= 3"), "words")
    n = float(total["n"])
    chosen: set[bytes] = set()
    for c in categories:
        y = float(total[c])
        if not 0 < y < n:
            continue
        cells = [(F.col(c), F.col("n") * (y / n)), (F.col("n") - F.col(c), F.col("n") * (1 - y / n)), (y - F.col(c), (n - F.col("n")) * (y / n)), (n - F.col("n") - y + F.col(c), (n - F.col("n")) * (1 - y / n))]
        ratio = sum((F.when(o > 0, o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
        best = sums.select("w", ratio.alias("r")).orderBy(F.desc("r"), "w").limit(vocabulary // len(categories))
        chosen |= {bytes(r.w) for r in best.collect()}
    return sorted(chosen)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, fit_rows: int = FIT_ROWS, vocabulary: int = VOCABULARY, modulus: int = 4, held: int = 2) -> Chain:
    """Learn from labelled ids whose crc32 as text mod `modulus` is not `held`."""
    categories = categories or CATEGORIES
    names = list(categories)
    flags = labels.where("doc_id is not null").select("doc_id", *(F.expr(e).cast("int").alias(c) for c, e in categories.items())).dropna()
    flags = flags.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in names)).where(crc_fold(F.col("doc_id"), modulus) != held)
    ids = bounded_rows(flags, F.col("doc_id"), fit_rows)
    texts = docs.select("doc_id", "text")
    # by merge at every size: were the flags broadcast while small, small runs would say nothing about large ones
    chain = Chain(choose_words(texts.join(flags.hint("merge"), "doc_id"), names, vocabulary))
    rows = texts.join(F.broadcast(ids), "doc_id")

    def run(batches):
        for batch in batches:
            features = chain.features(batch["text"]).astype(np.float32)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "f": list(features), **{c: batch[c] for c in names}})

    featured = rows.select("doc_id", "text", *names).mapInPandas(run, "doc_id long, f array<float>, " + ", ".join(f"{c} int" for c in names))
    found = bounded_rows(featured, F.col("doc_id"), fit_rows).toPandas()  # an id may have any number of rows
    if found.empty:
        chain.models = {c: 0.0 for c in names}
        return chain
    found = found.sort_values("doc_id", kind="stable")
    targets = {c: found[c].to_numpy() for c in names}
    folds, features = found["doc_id"].to_numpy() % FOLDS, np.stack(found["f"].to_numpy()).astype(np.float32)
    del found
    return fit_arrays(chain.words, features, targets, folds)


def score_columns(chain: Chain, text: Column) -> Column:
    """A struct of one probability for each category."""
    schema = ", ".join(f"{c} double" for c in chain.models)

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        parts = [chain.probabilities(chain.features(texts.iloc[k : k + 500].tolist())) for k in range(0, len(texts), 500)]
        return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) if parts else [] for c in chain.models})

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.5, **how) -> DataFrame:
    """(doc_id, held_out, one probability p_<category> each, toxic boolean: p_toxic >= cut) of every row of `docs`."""
    chain = fit_chain(docs, labels, **how)
    scored = docs.select("doc_id", score_columns(chain, docs["text"]).alias("p"))
    last = "toxic" if "toxic" in chain.models else list(chain.models)[-1]
    held = crc_fold(F.col("doc_id"), how.get("modulus", 4)) == how.get("held", 2)
    return scored.select("doc_id", held.alias("held_out"), *(F.col(f"p.{c}").alias(f"p_{c}") for c in chain.models), (F.col(f"p.{last}") >= cut).alias("toxic"))
