"""Rows with empty keys, labels or flags, and values outside usual ranges, keep their place."""

import numpy as np
from pyspark.sql import functions as F

from modalframe.operators import features, metrics, ordered, sampling, scale, split
from modalframe.sources.tables import default_flags
from modalframe.sources.wide import to_wide


def scored(spark):
    rows = [(k, None if k % 4 == 0 else f"p{k % 3}", (k * 37 % 101) / 101, float(k * 7 % 5 == 0)) for k in range(200)]
    return spark.createDataFrame(rows, "id long, pattern string, score double, label double")


def test_null_group_has_metrics(spark):
    df = scored(spark)
    both = {r["pattern"]: r for r in metrics.ranking_metrics(df, ["pattern"]).collect()}
    brief = {r["pattern"]: r for r in metrics.auc_and_brier(df, ["pattern"]).collect()}
    assert set(both) == set(brief) == {None, "p0", "p1", "p2"}
    for p, r in brief.items():
        assert abs(both[p]["auc"] - r["auc"]) < 1e-12
    curve = metrics.score_curve(df, ["pattern"]).groupBy("pattern").agg((F.sum("pos") + F.sum("neg")).alias("n")).collect()
    assert sum(r["n"] for r in curve) == 200


def test_absurd_cut_points_change_nothing(spark):
    df = scored(spark)
    plain = metrics.ranking_metrics(df, ["pattern"]).orderBy("pattern").collect()
    for cuts in ([], [-1e9], [0.5, 0.5000001], [5.0, 6.0], [k / 1000 for k in range(1000)]):
        for a, b in zip(plain, metrics.ranking_metrics(df, ["pattern"], splits=cuts).orderBy("pattern").collect()):
            assert all(x == y or abs(x - y) < 1e-12 for x, y in zip(a, b) if isinstance(x, float))


def test_cut_points_are_even(spark):
    df = spark.range(0, 100_000, 1, 16).select((F.col("id") * 1.0).alias("v"))
    cuts = ordered.value_splits(df, "v", 10)
    assert len(cuts) == 9 and np.allclose(cuts, np.arange(1, 10) * 10_000, atol=2000)


def test_rows_without_label_or_pattern_are_not_sampled(spark):
    rows = [(k, None if k % 5 == 0 else k % 2, None if k % 97 == 0 else k % 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "subject_id long, y int, pattern_code int")
    valid = {k for k, y, p in rows if y is not None and p is not None}
    weights = {r["subject_id"]: r["weight"] for r in sampling.sample_weights(df, "y").collect()}
    assert len(weights) == 1000 and abs(sum(weights.values()) - len(valid)) < 1e-6
    assert {k for k, w in weights.items() if w > 0} == valid
    draws = sampling.weighted_sample(df, "y")
    got = draws.collect()
    assert len(got) == len(valid) and {r["subject_id"] for r in got} <= valid
    assert "NestedLoop" not in draws._jdf.queryExecution().toString()
    assert sampling.weighted_sample(df.filter("y IS NULL"), "y").count() == 0


def test_missing_label_is_a_stratum(spark):
    df = spark.createDataFrame([(k, None, 0, 15) for k in range(200)], "subject_id long, m int, r int, code int")
    for bound in (None, 9):
        out = split.assign_split(df, split.stratum_of("m", "r", "code"), few_strata=bound)
        counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
        assert counts == {"test": 40, "val": 24, "train": 136}


def test_wide_layout_keeps_all_vectors(spark):
    df = spark.createDataFrame([(1, k, [float(k)]) for k in range(5)] + [(2, 0, [9.0])], "id long, k int, v array<double>")
    for width, columns in ((2, 5), (None, 5), (7, 7)):
        wide = to_wide(df, "id", "v", ["k"], width=width)
        assert len(wide.columns) == columns + 1
        assert sum(1 for r in wide.collect() for c in wide.columns[1:] if r[c]) == 6


def test_empty_flag_means_absent(spark):
    df = spark.createDataFrame([("1", None, "1.0", "x")], "has_struct string, has_img string, has_text string, has_rad string")
    assert tuple(default_flags(df).first()) == (1, 0, 1, 0)


def test_power_exponent_beyond_the_first_grid(spark):
    rng = np.random.default_rng(1)
    lam = 9.0
    x = np.power(rng.normal(100, 9, 800) * lam + 1, 1 / lam) - 1
    fit = scale.fit_scaler(spark.createDataFrame([(float(v),) for v in x], "v double"), ["v"], "power")["v"]
    y = scale.yeo_johnson(F.col("v"), fit.power)
    assert fit.power > 5.6 and abs(fit.power - lam) < 5
    assert spark.createDataFrame([(float(v),) for v in x], "v double").select(F.abs(F.skewness(y)).alias("s")).first()["s"] < 0.3


def test_details_are_restricted_before_they_are_exchanged(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        detail = spark.createDataFrame([(s, h, f"c{k}") for s in range(20) for h in range(5) for k in range(3)], "subject_id long, hadm_id long, icd_code string")
        pairs = spark.createDataFrame([(s, 2) for s in range(20)], "subject_id long, hadm_id long")
        frame = features.combined_frame({"diagnoses_icd": detail}, pairs)
        assert {tuple(r) for r in frame.collect()} == {(s, 2, 3, 3) for s in range(20)}
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("LeftSemi") > plan.rindex("Aggregate")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
