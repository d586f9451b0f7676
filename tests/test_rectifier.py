import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalframe.operators import rectifier as R


def group(spark, rows):
    return spark.createDataFrame([("t", m, float(p), float(y), float(w)) for m, p, y, w in rows], "task string, modality string, p double, y double, w double")


def rules(e, n):
    """The documented guards, for plain numbers."""
    if n < 10:
        return 0.0, 0.0
    var, d = max(np.var(e, ddof=1), 1e-4), np.mean(e)
    d = math.copysign(min(abs(d), 0.3), d)
    if n < 30:
        d *= max(0.3, n / 30)
    ratio = abs(d) / math.sqrt(var)
    if var > 0.2 and abs(d) > 0.01 and ratio < 0.5:
        d *= min(0.8, max(0.2, ratio))
    return d, var


@pytest.mark.parametrize("n", [9, 10, 19, 20, 29, 30, 60])
@pytest.mark.parametrize("shift", [0.0, 0.05, 0.45])
def test_fit_guards(spark, n, shift):
    rng = np.random.default_rng(n)
    y = rng.integers(0, 2, n)
    p = np.clip(0.5 * y + 0.2 + shift, 0, 1)
    row = R.fit(group(spark, [("m", a, b, 1) for a, b in zip(p, y)]), "p", "y").first()
    d, v = rules(p - y, n)
    assert row["delta"] == pytest.approx(d) and row["var_delta"] == pytest.approx(v)
    assert row["n"] == n and row["n_initial"] == (n if n >= 10 else None)


def test_noisy_labels_are_cleaned(spark):
    good = [("m", 0.5, i % 2, 1) for i in range(10)]
    dirty = [("m", float("nan"), 1, 1), ("m", 0.4, float("inf"), 1), ("m", 1.7, 0.6, 1), ("m", -1, 0.5, 1)]
    row = R.fit(group(spark, good + dirty), "p", "y").first()
    p, y = np.array([0.5] * 10 + [1.0, 0.0]), np.array([0, 1] * 5 + [1, 0])
    d, v = rules(p - y, 12)
    assert row["n"] == 12 and row["delta"] == pytest.approx(d) and row["var_delta"] == pytest.approx(v)


def test_weighted_fit(spark):
    rng = np.random.default_rng(0)
    p, y, w = rng.random(50), rng.integers(0, 2, 50), rng.random(50)
    row = R.fit(group(spark, [("m", *t) for t in zip(p, y, w)]), "p", "y", weight="w").first()
    v, e = w / w.sum(), p - y
    d, n_eff = (v * e).sum(), 1 / (v**2).sum()
    var = (v * (e - d) ** 2).sum() * n_eff / (n_eff - 1)
    d = math.copysign(min(abs(d), 0.3), d)
    if int(n_eff) < 30:
        d *= max(0.3, int(n_eff) / 30)
    if var > 0.2 and abs(d) > 0.01 and abs(d) / math.sqrt(var) < 0.5:
        d *= min(0.8, max(0.2, abs(d) / math.sqrt(var)))
    assert row["delta"] == pytest.approx(d) and row["var_delta"] == pytest.approx(var)
    zero = R.fit(group(spark, [("m", *t, 0) for t in zip(p, y)]), "p", "y", weight="w").first()
    plain = R.fit(group(spark, [("m", *t, 0) for t in zip(p, y)]), "p", "y").first()
    assert zero["delta"] == pytest.approx(plain["delta"])


def test_refit_keeps_first_count_and_shrinks(spark):
    many = R.fit(group(spark, [("m", 0.6, i % 2, 1) for i in range(100)]), "p", "y")
    few_rows = group(spark, [("m", 0.6, i % 2, 1) for i in range(40)])
    refit = R.fit(few_rows, "p", "y", previous=many)
    row = refit.first()
    assert (row["n"], row["n_initial"]) == (40, 100)
    t = R.transform(few_rows, refit, "p").first()
    assert t["delta_adj"] == pytest.approx(row["delta"] * 0.4)
    late, early = (R.transform(few_rows, refit, "p", epoch=e).first()["delta_adj"] for e in (20, 5))
    assert late == pytest.approx(t["delta_adj"] * 0.5) and early == pytest.approx(t["delta_adj"] * 0.1)


def test_transform_unknown_and_empty(spark):
    params = R.fit(group(spark, [("m", 0.6, i % 2, 1) for i in range(40)]), "p", "y")
    rows = group(spark, [("other", 0.5, 0, 1), ("m", float("nan"), 0, 1)])
    out = {r["modality"]: r for r in R.transform(rows, params, "p").collect()}
    assert out["other"]["status"] == "unfitted" and out["other"]["delta_adj"] is None
    assert out["m"]["status"] == "empty" and out["m"]["theta_rect"] == 0.0


def test_ci_is_symmetric_and_guarded(spark):
    df = spark.createDataFrame([(0.4, 0.1, 0.05, 0.02, 50, 60), (0.4, 0.1, 0.05, 0.02, 1, 60), (0.4, -0.1, 0.05, 0.02, 50, 60)],
        "theta_tilde double, var_f double, delta_adj double, var_delta double, n long, n_unlabeled long")
    a, b, c = R.confidence_interval(df).collect()
    assert a["ci_center"] == pytest.approx(0.35) and a["ci_high"] - a["ci_center"] == pytest.approx(a["ci_center"] - a["ci_low"])
    assert a["ci_high"] - a["ci_center"] == pytest.approx(1.959964 * math.sqrt(0.02 / 50 + 0.1 / 60), rel=1e-6)
    assert b["ci_low"] is None and c["ci_center"] is None
    with pytest.raises(ValueError):
        R.confidence_interval(df, alpha=1.0)


@pytest.mark.parametrize("p, want", [(0.39, 0.39), (0.4, 0.45), (0.44, 0.49), (0.46, 0.39), (0.5, 0.5), (0.54, 0.61), (0.56, 0.51), (0.61, 0.61), (1.2, 1.0)])
def test_rank_aware_zones(spark, p, want):
    df = spark.createDataFrame([(float(p),)], "p double")
    zero = F.lit(0.0)
    assert df.select(R.rank_aware(F.col("p"), zero, F.lit(True)).alias("c")).first()["c"] == pytest.approx(want)
    assert df.select(R.rank_aware(F.col("p"), F.lit(None).cast("double"), F.lit(True)).alias("c")).first()["c"] == p
    assert df.select(R.rank_aware(F.col("p"), zero, F.lit(False)).alias("c")).first()["c"] == min(p, 1.0)


def test_rank_aware_edges_are_optional(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.9,)], "p double")
    got = [r["c"] for r in df.select(R.rank_aware(F.col("p"), F.lit(0.0), F.lit(True), edge_adjust=True).alias("c")).collect()]
    assert got == pytest.approx([0.09, 0.27, 0.91])


def test_subtract_delta_only_where_flag_is_zero(spark):
    params = spark.createDataFrame([("t", "m", 0.1)], "task string, modality string, delta double")
    df = spark.createDataFrame([("t", "m", 0.05, 0), ("t", "m", 0.05, 1), ("t", "x", 0.05, 0)], "task string, modality string, p double, f int")
    got = {(r["modality"], r["f"]): r["corrected"] for r in R.subtract_delta(df, params, "p", "f").collect()}
    assert got == {("m", 0): pytest.approx(-0.05), ("m", 1): 0.05, ("x", 0): 0.05}
