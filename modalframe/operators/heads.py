"""Logistic heads over one feature array, fitted together: every scan of the rows serves all of them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..functions.vectors import as_double, dot

SUM_GROUPS = 64
TOLERANCE = 1e-9


class Head(NamedTuple):
    """`gradient_norm` is the largest entry of the gradient at the coefficients, `scans` the number of passes over the rows until then."""

    intercept: float
    coefficients: list[float]
    gradient_norm: float
    scans: int

    def logit(self, features: str | Column) -> Column:
        return dot(features, F.array(*[F.lit(float(c)) for c in self.coefficients])) + F.lit(float(self.intercept))

    def probability(self, features: str | Column) -> Column:
        return sigmoid(self.logit(features))


def sums_at(rows: DataFrame, center: np.ndarray, spread: np.ndarray, at: dict[int, np.ndarray]) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
    """Weight, loss, gradient and Hessian sums of every head in `at` (its coefficients, the intercept last) in one scan of `rows(x, w, y)`.

    A task sums its rows to one row per head and line of the Hessian's upper triangle. These are summed in two levels, so that no reducer takes in
    a row of every task; the driver sees heads x dimension rows.
    """
    d = len(center) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {k: np.zeros((d + 1, d)) for k in at}
        sizes = {k: np.zeros(2) for k in at}
        some = False
        for batch in batches:
            if len(batch) == 0:
                continue
            some = True
            z = np.ones((len(batch), d))
            z[:, :-1] = (np.stack(batch["x"].to_numpy()) - center) * spread
            weight, targets = batch["w"].to_numpy(), np.stack(batch["y"].to_numpy()).astype(float)
            for k, beta in at.items():
                y = targets[:, k]
                w = np.where(np.isnan(y), 0.0, weight)  # a row without this label does not count for this head
                y = np.nan_to_num(y)
                margin = z @ beta
                p = 0.5 * (1.0 + np.tanh(0.5 * margin))
                part = total[k]
                part[0] += (w * (p - y)) @ z
                part[1:] += (z * (w * p * (1.0 - p))[:, None]).T @ z
                loss = np.maximum(margin, 0.0) + np.log1p(np.exp(-np.abs(margin))) - y * margin
                sizes[k] += (w.sum(), (w * loss).sum())
        if some:
            for k, part in total.items():
                # line 0: weight, loss, gradient; line 1 + i: the Hessian from the diagonal on
                lines = [np.concatenate([sizes[k], part[0]]), *(part[1 + i, i:] for i in range(d))]
                yield pd.DataFrame({"k": k, "i": np.arange(len(lines)), "v": lines})

    parts = rows.mapInPandas(partial, "k int, i int, v array<double>").withColumn("g", F.spark_partition_id() % SUM_GROUPS)
    for keys in (("k", "i", "g"), ("k", "i")):
        parts = parts.groupBy(*keys).agg(Summarizer.sum(array_to_vector("v")).alias("v")).withColumn("v", vector_to_array("v"))
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.collect():
        found.setdefault(r["k"], {})[r["i"]] = np.array(r["v"])
    out = {}
    for k, lines in found.items():
        hessian = np.zeros((d, d))
        for i in range(d):
            hessian[i, i:] = lines[1 + i]
        hessian += np.triu(hessian, 1).T
        out[k] = (lines[0][0], lines[0][1], lines[0][2:], hessian)
    return out


def fit_heads(
    rows: DataFrame, features: str, labels: dict[str, str], weight: str | None = None, max_scans: int = 50, reg: float = 0.01, tolerance: float = TOLERANCE
) -> dict[str, Head]:
    """A weighted, ridge-regularised logistic head per entry of `labels` (task -> 0/1 column): mean loss + reg/2 * squared coefficients of the standardised features.

    Newton steps for all heads at once, each halved while its loss would rise; heads that have settled leave the scans. The fit is over all rows
    with features; a row without a label does not count for that head, and NULL or negative weights count as 0. A head whose rows have one class only gets
    no coefficients and an infinite intercept. The sums have the square of the feature dimension in size, whatever the number of rows.
    """
    y = F.array(*[F.col(c).cast("double") for c in labels.values()])
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight else F.lit(1.0)
    slim = rows.select(as_double(features).alias("x"), w.alias("w"), y.alias("y")).filter(F.col("x").isNotNull())
    counts = [F.sum(F.when(F.col("y")[i].isNotNull(), F.col("w") * F.col("y")[i])).alias(f"p{i}") for i in range(len(labels))]
    known = [F.sum(F.when(F.col("y")[i].isNotNull(), F.col("w"))).alias(f"n{i}") for i in range(len(labels))]
    moments = Summarizer.metrics("mean", "std").summary(array_to_vector("x"), F.col("w")).alias("m")
    first = slim.filter("w > 0").groupBy(F.lit(1)).agg(moments, *counts, *known).first()  # no row at all without rows
    if first is None or not any(first[f"n{i}"] for i in range(len(labels))):
        raise ValueError("no rows to fit on")
    center, std = first["m"]["mean"].toArray(), first["m"]["std"].toArray()
    d = len(center)
    spread = np.divide(1.0, std, out=np.zeros(d), where=std > 0)
    ridge = np.append(np.where(std > 0, reg, 1.0), 0.0)  # a constant feature gets no coefficient
    beta: dict[int, np.ndarray] = {}
    done: dict[int, Head] = {}
    for i in range(len(labels)):
        n, p = first[f"n{i}"] or 0.0, first[f"p{i}"] or 0.0
        if not 0.0 < p < n:
            done[i] = Head(float("inf") if n and p >= n else float("-inf") if n else float("nan"), [0.0] * d, 0.0, 0)
        else:
            beta[i] = np.append(np.zeros(d), np.log(p / (n - p)))
    best = {i: np.inf for i in beta}
    move: dict[int, np.ndarray] = {}
    norm: dict[int, float] = {}
    for scan in range(1, max_scans + 1):
        open_heads = {i: b for i, b in beta.items() if i not in done}
        if not open_heads:
            break
        for i, (n, loss, gradient, hessian) in sums_at(slim, center, spread, open_heads).items():
            loss = loss / n + 0.5 * float(ridge @ beta[i] ** 2)
            if loss > best[i] + 1e-12:
                move[i] = move[i] / 2.0
                beta[i] = beta[i] - move[i]  # back by half of the last step
                continue
            best[i] = loss
            gradient = gradient / n + ridge * beta[i]
            norm[i] = float(np.abs(gradient).max())
            if norm[i] <= tolerance or scan == max_scans:
                raw = beta[i][:-1] * spread
                done[i] = Head(float(beta[i][-1] - raw @ center), raw.tolist(), norm[i], scan)
                continue
            move[i] = -np.linalg.solve(hessian / n + np.diag(ridge) + 1e-12 * np.eye(d + 1), gradient)
            beta[i] = beta[i] + move[i]
    if len(done) < len(labels):
        raise ArithmeticError(f"no minimum in {max_scans} scans: gradients {norm}")
    return {task: done[i] for i, task in enumerate(labels)}


def gradient_at(rows: DataFrame, features: str, labels: dict[str, str], heads: dict[str, Head], reg: float = 0.01) -> DataFrame:
    """`(task, n, positives, mean_probability, gradient)`: the unweighted objective's largest gradient entry at given heads, in column expressions and thus independent of the fit."""
    items = [F.struct(F.lit(t).alias("task"), F.col(c).cast("double").alias("y"), heads[t].probability(features).alias("p")) for t, c in labels.items()]
    x = as_double(features)
    # two arrays of the feature dimension
    found = rows.agg(Summarizer.metrics("mean", "std").summary(array_to_vector(x)).alias("m")).first()["m"]
    mu, sd = (F.array(*[F.lit(float(v)) for v in found[m].toArray()]) for m in ("mean", "std"))
    long = rows.select(x.alias("x"), F.explode(F.array(*items)).alias("s")).select("x", "s.*").filter("y IS NOT NULL")
    z = F.zip_with(F.zip_with("x", mu, lambda a, b: a - b), sd, lambda a, s: F.when(s > 0, a / s).otherwise(0.0))
    pull = F.transform(F.concat(z, F.array(F.lit(1.0))), lambda v: v * (F.col("p") - F.col("y")))
    sums = long.groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.avg("p").alias("mean_probability"),
        vector_to_array(Summarizer.mean(array_to_vector(pull))).alias("g"),
    )
    coefficients = F.create_map(*[e for t, h in heads.items() for e in (F.lit(t), F.array(*[F.lit(float(c)) for c in h.coefficients], F.lit(0.0)))])[F.col("task")]
    ridge = F.zip_with(coefficients, F.concat(sd, F.array(F.lit(0.0))), lambda b, s: F.lit(reg) * b * s)
    worst = F.array_max(F.transform(F.zip_with("g", ridge, lambda a, b: a + b), F.abs))
    return sums.select("task", "n", F.col("positives").cast("long").alias("positives"), "mean_probability", worst.alias("gradient"))
