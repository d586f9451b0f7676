"""The power transform's fit: peaks by a fine search, lambdas of any size, odd columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalframe.operators import scale


def exact_likelihood(x, lam):
    """In 80-digit arithmetic, so that large powers neither overflow nor cancel."""
    from decimal import Decimal, localcontext

    with localcontext() as c:
        c.prec = 80
        lam = Decimal(lam)
        y = []
        for v in x:
            w = (Decimal(abs(v)) + 1).ln()
            a = lam if v >= 0 else 2 - lam
            t = w if a == 0 else ((a * w).exp() - 1) / a
            y.append(t if v >= 0 else -t)
        mean = sum(y) / len(y)
        var = sum((v - mean) ** 2 for v in y) / len(y)
        slope = sum((Decimal(abs(v)) + 1).ln() * (1 if v > 0 else -1) for v in x)
        return float(-Decimal(len(x)) / 2 * var.ln() + (lam - 1) * slope)


def columns(rng):
    return {
        "lognormal": np.exp(rng.normal(size=150)),
        "negative": -np.exp(rng.normal(size=150)),
        "both": rng.normal(size=150) * 3,
        "steep": np.sqrt(np.arange(2_000_000, 2_000_150.0)) * 100,  # close together: a lambda far from 1
        "narrow": 1000 + np.exp(rng.normal(size=150)) / 100,
        "two_values": np.where(np.arange(150) < 40, 2.0, 900.0),
        "far_apart": np.concatenate([rng.uniform(1, 2, 149), [1e12]]),
    }


@pytest.fixture(scope="module")
def fitted(spark):
    data = columns(np.random.default_rng(5))
    names = list(data)
    df = spark.createDataFrame([tuple(float(data[c][i]) for c in names) for i in range(150)], ", ".join(f"{c} double" for c in names)).repartition(4)
    return data, df, scale.fit_scaler(df, names, "power")


def test_every_lambda_is_a_peak(fitted):
    data, _, found = fitted
    for c, x in data.items():
        lam = found[c].power
        at = exact_likelihood(x, lam)
        assert at >= max(exact_likelihood(x, lam - 0.01), exact_likelihood(x, lam + 0.01)) - 1e-9, (c, lam)


def test_lambdas_have_no_limit(fitted):
    powers = {c: s.power for c, s in fitted[2].items()}
    assert powers["narrow"] < -1000 and abs(powers["lognormal"]) < 2 and powers["negative"] > 1 and min(powers.values()) == powers["narrow"]


def test_scaled_columns_are_standard(fitted):
    data, df, found = fitted
    out = scale.apply_scaler(df, found)
    for c in data:
        r = out.agg(F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.corr(F.lit(1.0) * F.col(c), F.col(c)).alias("k")).first()
        assert (r["m"], r["s"]) == (pytest.approx(0, abs=1e-5), pytest.approx(1, abs=1e-5)), c
    joined = np.array(df.select(*data).collect(), dtype=float), np.array(out.select(*data).collect(), dtype=float)
    for i, c in enumerate(data):
        order = np.argsort(joined[0][:, i], kind="stable")
        assert (np.diff(joined[1][order, i]) >= -1e-12).all(), c  # the order of values stays


def test_odd_columns(spark):
    rows = [(5.0, None, float("nan"), 0.0, float(i)) for i in range(4)] + [(5.0, None, 1.0, 0.0, None)]
    df = spark.createDataFrame(rows, "same double, none double, nan double, zero double, some double")
    found = scale.fit_scaler(df, df.columns, "power")
    assert set(found) == {"same", "nan", "some"} and found["same"].power == 1.0
    out = scale.apply_scaler(df, found).collect()
    assert [r["same"] for r in out] == [0.0] * 5 and [r["none"] for r in out] == [None] * 5 and [r["zero"] for r in out] == [0.0] * 5
    assert scale.fit_scaler(df.limit(0), df.columns, "power") == {}


def test_values_beyond_the_fitted_range_keep_their_order(spark, fitted):
    found = fitted[2]["narrow"]
    probe = spark.createDataFrame([(v,) for v in (-1e6, -3.0, 999.0, 1000.5, 2e9)], "v double")
    moved = [r[0] for r in probe.select(scale.scaled("v", found)).collect()]
    assert moved == sorted(moved) and all(math.isfinite(v) for v in moved)
