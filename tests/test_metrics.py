import numpy as np
import pytest

from modalframe.operators import metrics as M
from modalframe.operators.ordered import row_numbers, hash_bucket, ordered_bucket, rows_at_ranks
from modalframe.operators.quantiles import exact_quantiles, quantile_match, rank_sigmoid
from modalframe.functions.numeric import hash_key
from pyspark.sql import functions as F


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    d = pos[:, None] - neg[None, :]
    return ((d > 0).sum() + (d == 0).sum() / 2) / d.size


def brute_ap(y, s):
    total, prev = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        total += (recall - prev) * precision
        prev = recall
    return total


def scored(spark, y, s, g=None):
    rows = [(float(a), float(b), "a" if g is None else g[i]) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(rows, "label double, score double, g string")


@pytest.mark.parametrize("n_values", [3, 50, 100000])
def test_ranking_metrics_match_brute_force(spark, n_values):
    rng = np.random.default_rng(n_values)
    s = rng.integers(0, n_values, 600) / n_values
    y = (rng.random(600) < 0.3 + 0.4 * s).astype(int)
    s[:200] = s[0]  # a third of all rows share one score
    df = scored(spark, y, s)
    full, fast = M.ranking_metrics(df, ["g"], n_buckets=8).first(), M.auc_and_brier(df, ["g"], n_buckets=8).first()
    assert full["auc"] == pytest.approx(brute_auc(y, s)) and fast["auc"] == pytest.approx(brute_auc(y, s))
    assert full["ap"] == pytest.approx(brute_ap(y, s))
    assert full["brier"] == pytest.approx(((s - y) ** 2).mean()) and fast["brier"] == pytest.approx(((s - y) ** 2).mean())


def test_auc_properties(spark):
    rng = np.random.default_rng(5)
    s, y = rng.random(300), rng.integers(0, 2, 300)
    auc = lambda v: M.auc_and_brier(scored(spark, y, v)).first()["auc"]
    assert auc(s) + auc(1 - s) == pytest.approx(1.0)
    assert auc(s) == pytest.approx(auc(s**3 / 2))


def test_one_class_and_unusable_rows(spark):
    df = scored(spark, [1, 1, 1, 0, 1], [0.2, 0.3, float("nan"), 0.4, 0.9], ["one", "one", "one", "two", "two"])
    out = {r["g"]: r for r in M.ranking_metrics(df, ["g"]).collect()}
    assert out["one"]["auc"] is None and out["one"]["n"] == 2 and out["one"]["ap"] == 1.0
    assert out["two"]["auc"] == 1.0
    assert M.auc_and_brier(df.filter("g = 'none'"), ["g"]).collect() == []


def test_curve_points(spark):
    df = scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    roc = sorted((r["fpr"], r["tpr"]) for r in M.roc_points(df).collect())
    assert roc == [(0.0, 0.0), (0.0, 0.5), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    pr = {(r["recall"], round(r["precision"], 6)) for r in M.pr_points(df).collect()}
    assert pr == {(0.0, 1.0), (0.5, 1.0), (0.5, 0.5), (1.0, 0.666667), (1.0, 0.5)}
    straight = scored(spark, [1, 1, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.5])
    thin = {(r["fpr"], r["tpr"]) for r in M.roc_points(straight, thin=True, splits=[]).collect()}
    assert (0.0, 0.0) in thin and (0.0, 1.0) in thin and (1.0, 1.0) in thin and len(thin) < 6


def test_row_numbers_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    vals = np.where(rng.random(500) < 0.4, 0.5, rng.random(500))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "id long, v double")
    got = {r["id"]: r["rn"] for r in row_numbers(df, [], ["v", "id"], ordered_bucket(df, ["v", "id"], 16)).collect()}
    want = {i: k + 1 for k, i in enumerate(sorted(range(500), key=lambda i: (vals[i], i)))}
    assert got == want


def test_rows_at_ranks(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("h", hash_key("id", 1))
    got = {(r["g"], r["tag"]): r["id"] for r in rows_at_ranks(df, ["g"], ["h", "id"], hash_bucket("h"), {"a": F.lit(1), "b": F.col("n"), "c": F.lit(0)}).collect()}
    rows = df.collect()
    for g in range(3):
        order = sorted((r["h"], r["id"]) for r in rows if r["g"] == g)
        assert got[(g, "a")] == order[0][1] and got[(g, "b")] == order[-1][1] and (g, "c") not in got


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=333), np.where(rng.random(333) < 0.5, 7.0, rng.random(333))
    rows = [(float(x), float(y), None) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    q = exact_quantiles(df, ["a", "b", "c"], (0.1, 0.25, 0.5, 0.75))
    assert q["a"] == pytest.approx(np.quantile(a, (0.1, 0.25, 0.5, 0.75)).tolist())
    assert q["b"] == pytest.approx(np.quantile(b, (0.1, 0.25, 0.5, 0.75)).tolist())
    assert "c" not in q


def test_quantile_match_and_sigmoid(spark):
    rng = np.random.default_rng(3)
    p, ref = rng.random(40), rng.random(25)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "id long, s double")
    rf = spark.createDataFrame([(i, float(v)) for i, v in enumerate(ref)], "rid long, r double")
    got = {r["id"]: r["normalized"] for r in quantile_match(df, rf, "s", "id", "r", "rid").collect()}
    ranks = np.argsort(np.argsort(p)) / 39
    want = np.interp(ranks, np.linspace(0, 1, 25), np.sort(ref))
    assert [got[i] for i in range(40)] == pytest.approx(want.tolist())
    few = {r["id"]: r["normalized"] for r in quantile_match(df, rf.limit(10), "s", "id", "r", "rid").collect()}
    assert [few[i] for i in range(40)] == pytest.approx((1 / (1 + np.exp(-6 * (ranks - 0.5)))).tolist())
    assert rank_sigmoid(df.limit(1), "s", "id").first()["normalized"] == df.limit(1).first()["s"]
