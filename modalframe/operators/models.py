"""Outcome scoring, pattern classification and cross-modality imputation on Spark ML and Gram sums."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import FLAGS, modality_count, pattern_string
from ..functions.vectors import as_double, scale
from .heads import SUM_GROUPS, Head, fit_heads
from .labels import DEATH, ICU, READMISSION

# Task -> label column
TASK_LABELS = {"readmission": READMISSION, "icu": ICU, "mortality": DEATH}


def fit_outcome_models(
    train: DataFrame, features: str, labels: dict[str, str] | None = None, weight: str | None = None, max_scans: int = 50, reg: float = 0.01
) -> dict[str, Head]:
    """One weighted logistic head per task over the same feature array, all fitted in the same scans."""
    return fit_heads(train, features, labels or TASK_LABELS, weight, max_scans, reg)


def predict_outcomes(df: DataFrame, models: dict[str, Head], features: str, labels: dict[str, str] | None = None, ident: str = "subject_id") -> DataFrame:
    """Prediction table: id, target and probability per task, flags, modality count and pattern."""
    labels = labels or TASK_LABELS
    out = [c for t, y in labels.items() for c in (F.col(y).cast("double").alias(f"{t}_target"), models[t].probability(features).alias(f"{t}_prediction"))]
    return df.select(ident, *out, *FLAGS, modality_count().alias("modality_count"), pattern_string().alias("missing_pattern"))


def fit_pattern_classifier(train: DataFrame, features: str, pattern: str = "pattern_code", max_iter: int = 1000, reg: float = 0.01, tol: float = 1e-13) -> LogisticRegressionModel:
    """Multinomial logistic regression of the pattern code on the features."""
    rows = train.select(pattern, array_to_vector(features).alias("_f"))
    estimator = LogisticRegression(featuresCol="_f", labelCol=pattern, family="multinomial", maxIter=max_iter, regParam=reg, tol=tol, predictionCol="_y", probabilityCol="_p")
    return estimator.fit(rows)


def classify_patterns(train: DataFrame, df: DataFrame, features: str, pattern: str = "pattern_code", ident: str = "subject_id", max_iter: int = 1000, reg: float = 0.01) -> DataFrame:
    """The most likely pattern code of each row given its features: `(ident, pattern, predicted)`."""
    model = fit_pattern_classifier(train, features, pattern, max_iter, reg)
    return model.transform(df.select(ident, pattern, array_to_vector(features).alias("_f"))).select(ident, pattern, F.col("_y").cast("int").alias("predicted"))


def pattern_gradient(rows: DataFrame, features: str, model: LogisticRegressionModel, pattern: str = "pattern_code", reg: float = 0.01) -> DataFrame:
    """`(pattern, n, mean_probability, gradient)`: for each class seen, its rows, its mean probability over all rows, and the largest entry of the objective's gradient.

    Sums of one vector a class; classes are pattern codes, so there are at most 16.
    """
    scored = model.transform(rows.select(pattern, array_to_vector(features).alias("_f"))).select(pattern, "_f", vector_to_array("_p").alias("p"))
    spread = scored.agg(Summarizer.metrics("std").summary(F.col("_f")).alias("m")).first()["m"]["std"].toArray()
    long = scored.select(pattern, vector_to_array("_f").alias("x"), F.posexplode("p").alias("c", "p"))
    own = (F.col(pattern) == F.col("c")).cast("long")
    scale_ = F.array(*[F.lit(float(1 / s) if s > 0 else 0.0) for s in spread])
    # in units of each feature's spread, as the penalty is
    pull = F.zip_with("x", scale_, lambda v, s: v * s * (F.col("p") - own))
    sums = long.groupBy("c").agg(F.sum(own).alias("n"), F.avg("p").alias("mean_probability"), vector_to_array(Summarizer.mean(array_to_vector(pull))).alias("g"))
    beta = model.coefficientMatrix.toArray() * spread * reg
    penalty = F.create_map(*[e for c, line in enumerate(beta) for e in (F.lit(c), F.array(*[F.lit(float(v)) for v in line]))])[F.col("c")]
    worst = F.array_max(F.transform(F.zip_with("g", penalty, lambda a, b: a + b), F.abs))
    return sums.filter("n > 0").select(F.col("c").alias(pattern), "n", "mean_probability", worst.alias("gradient"))


def other_modalities(vectors: Sequence[str], flags: Sequence[str]) -> Column:
    """Concatenation of the present vectors (absent ones zeroed) and a constant 1 for the intercept."""
    return F.concat(*[scale(v, f) for v, f in zip(vectors, flags)], F.array(F.lit(1.0)))


def cross_sums(df: DataFrame, x: str, y: str) -> np.ndarray:
    """`[X'X, X'Y]` of the array columns `x` and `y`; no row for no rows.

    Every task adds up its own sums and sends them row by row, of X'X only the upper triangle. Rows are summed in two levels, first within
    `SUM_GROUPS` groups of tasks, so no reducer takes in a row of every task. The driver holds a matrix of the vectors' dimension,
    whatever the number of rows.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = None
        for batch in batches:
            if len(batch) == 0:
                continue
            a, b = np.stack(batch["x"].to_numpy()), np.stack(batch["y"].to_numpy())
            part = a.T @ np.hstack([a, b])
            gram = part if gram is None else gram + part
        if gram is not None:
            yield pd.DataFrame({"i": np.arange(len(gram)), "v": [line[i:] for i, line in enumerate(gram)]})

    rows = df.select(as_double(x).alias("x"), as_double(y).alias("y"))
    parts = rows.mapInPandas(partial, "i int, v array<double>").withColumn("g", F.spark_partition_id() % SUM_GROUPS)
    for keys in (("i", "g"), ("i",)):
        parts = parts.groupBy(*keys).agg(Summarizer.sum(array_to_vector("v")).alias("v")).withColumn("v", vector_to_array("v"))
    lines = [r["v"] for r in sorted(parts.collect(), key=lambda r: r["i"])]
    if not lines:
        return np.zeros((0, 0))
    d = len(lines)
    gram = np.zeros((d, len(lines[0])))
    for i, line in enumerate(lines):
        gram[i, i:] = line
    lower = np.tril_indices(d, -1)
    gram[lower] = gram[:, :d].T[lower]
    return gram


def fit_ridge(df: DataFrame, x: str, y: str, ridge: float = 1e-3) -> np.ndarray:
    """Ridge coefficients of array column `y` on array column `x`."""
    gram = cross_sums(df, x, y)
    d = len(gram)
    if not d:
        raise ValueError("no rows to fit on")
    return np.linalg.solve(gram[:, :d] + ridge * np.eye(d), gram[:, d:])


def map_vector(x: Column | str, weights: np.ndarray) -> Column:
    """`x` times `weights`, batch by batch; `weights` has the vectors' dimension squared, whatever the number of rows."""
    shared = SparkSession.active().sparkContext.broadcast(weights)

    @F.pandas_udf("array<double>")
    def product(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ shared.value)) if len(v) else pd.Series([], dtype=object)

    return product(x)


def ridge_residual(df: DataFrame, x: str, y: str, weights: np.ndarray, ridge: float = 1e-3) -> DataFrame:
    """`(pos, n, mean_value, residual)` for each entry of `y`: what fitted `weights` leave of the normal equations.

    `residual` is the largest entry of `X'(Y - XW) - ridge W` over the rows' number, from errors taken row by row and not from the sums of the
    fit. `mean_value` is the mean of the fitted values plus the intercept's share of the penalty (the last entry of `x` is the constant 1),
    which equals the mean of `y` where the residual vanishes.
    """
    fitted = df.select(as_double(x).alias("x"), as_double(y).alias("y")).withColumn("p", map_vector("x", weights))
    sums = cross_sums(fitted.withColumn("e", F.concat(F.zip_with("y", "p", lambda a, b: a - b), "p")), "x", "e")
    d, k = weights.shape
    n = sums[d - 1, d - 1]
    left = np.abs(sums[:, d : d + k] - ridge * weights).max(axis=0) / n
    means = (sums[d - 1, d + k :] + ridge * weights[-1]) / n
    rows = [(i, int(round(n)), float(means[i]), float(left[i])) for i in range(k)]
    return df.sparkSession.createDataFrame(rows, "pos int, n long, mean_value double, residual double")


def impute_modality(
    df: DataFrame, target: str, target_flag: str, others: Sequence[str], other_flags: Sequence[str], ridge: float = 1e-3, out: str | None = None
) -> DataFrame:
    """Fill an absent modality vector with its ridge prediction from the present ones; originals stay where present."""
    out = out or target
    rows = df.withColumn("_x", other_modalities(others, other_flags))
    weights = fit_ridge(rows.filter(F.col(target_flag) == 1), "_x", target, ridge)
    filled = rows.withColumn("_p", map_vector("_x", weights))
    return filled.withColumn(out, F.when(F.col(target_flag) == 1, as_double(target)).otherwise(F.col("_p"))).drop("_x", "_p")
