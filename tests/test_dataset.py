import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalframe.operators import clean, losses, models, sampling, scale, split, training


def features(spark, n=200, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, float(rng.gamma(2.0)), float(rng.normal() * 3) if i % 4 else 0.0, 5.0, None if i % 5 else float(i), None if i % 7 == 0 else "s") for i in range(n)]
    return spark.createDataFrame(rows, "subject_id long, a double, b double, const double, gaps double, txt string"), rows


def test_imputing_and_capping(spark):
    df, rows = features(spark)
    filled = clean.impute_mean(df.withColumn("none", F.lit(None).cast("double")))
    got = {r["subject_id"]: r for r in filled.collect()}
    mean = np.mean([r[4] for r in rows if r[4] is not None])
    assert got[1]["gaps"] == pytest.approx(mean) and got[0]["txt"] == "" and got[1]["none"] == 0.0
    spiked = df.withColumn("a", F.when(F.col("subject_id") == 3, 1000.0).otherwise(F.col("a")))
    values = np.array([1000.0 if r[0] == 3 else r[1] for r in rows])
    top = values.mean() + 3 * values.std(ddof=1)
    capped = {r["subject_id"]: r for r in clean.winsorize(clean.impute_mean(spiked)).collect()}
    assert capped[3]["a"] == pytest.approx(top) and capped[4]["a"] == values[4] and capped[3]["const"] == 5.0
    report = {r["column"]: r for r in clean.quality_report(spiked).collect()}
    assert (report["a"]["n_high"], report["a"]["n_low"], report["gaps"]["n_missing"]) == (1, 0, 160)


@pytest.mark.parametrize("method", ["robust", "minmax", "standard"])
def test_scalers_ignore_zeros_and_other_splits(spark, method):
    df, rows = features(spark)
    train = F.col("subject_id") < 150
    scalers = scale.fit_scaler(df, ["a", "b", "const"], method, train)
    b = np.array([r[2] for r in rows[:150] if r[2] != 0])
    center, width = {"robust": (np.median(b), np.subtract(*np.quantile(b, [0.75, 0.25]))), "minmax": (b.min(), np.ptp(b)), "standard": (b.mean(), b.std())}[method]
    assert scalers["b"].center == pytest.approx(center) and scalers["b"].scale == pytest.approx(width)
    assert scalers["const"].scale == 1.0
    got = {r["subject_id"]: r["b"] for r in scale.apply_scaler(df, scalers).collect()}
    assert got[0] == 0.0 and got[1] == pytest.approx((rows[1][2] - center) / width)


def test_power_scaler_finds_the_likelihood_peak(spark):
    df, rows = features(spark)
    found = scale.fit_scaler(df, ["a", "b"], "power")
    for c, k in (("a", 1), ("b", 2)):
        x = np.array([r[k] for r in rows if r[k] != 0])

        def transformed(lam):
            up = np.log1p(np.abs(x)) if abs(lam) < 1e-12 else ((np.abs(x) + 1) ** lam - 1) / lam
            down = -np.log1p(np.abs(x)) if abs(lam - 2) < 1e-12 else -((1 + np.abs(x)) ** (2 - lam) - 1) / (2 - lam)
            return np.where(x >= 0, up, down)

        def likelihood(lam):
            return -len(x) / 2 * math.log(transformed(lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()

        grid = np.arange(-3, 4, 0.0005)
        best = grid[np.argmax([likelihood(v) for v in grid])]
        assert found[c].power == pytest.approx(best, abs=2e-3)
        assert found[c].center == pytest.approx(transformed(found[c].power).mean()) and found[c].scale == pytest.approx(transformed(found[c].power).std())


def test_struct_vector_order_and_text(spark):
    df, _ = features(spark, 3)
    df = df.withColumn("idx_severity_mode", F.lit(9.0)).withColumn("num_text", F.lit("4"))
    row = scale.struct_vector(df).filter("subject_id = 1").first()
    assert len(row["x_struct"]) == 6 and row["x_struct"][4:] == [0.0, 4.0]


def labelled(spark, n=1000):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.random() < 0.2), int(rng.random() < 0.5), int(rng.choice([8, 10, 14, 15], p=[0.1, 0.6, 0.2, 0.1]))) for i in range(n)]
    return spark.createDataFrame(rows, "subject_id long, mort int, readm int, pattern_code int"), rows


def test_split_counts_per_stratum(spark):
    df, rows = labelled(spark)
    out = split.assign_split(df, split.stratum_of("mort", "readm", "pattern_code")).collect()
    assert len(out) == len(rows) == len({r["subject_id"] for r in out})
    per = {}
    for r in out:
        per.setdefault(4 * r["mort"] + 2 * r["readm"] + (r["pattern_code"] == 15), []).append(r["split"])
    for parts in per.values():
        n = len(parts)
        test = int(n * 0.2 + 0.5)
        assert parts.count("test") == test and parts.count("val") == int((n - test) * 0.15 + 0.5)
    other = split.assign_split(df, split.stratum_of("mort", "readm", "pattern_code"), seed=7).collect()
    assert {r["subject_id"] for r in out if r["split"] == "test"} != {r["subject_id"] for r in other if r["split"] == "test"}


def test_sample_weights_and_sampling(spark):
    df, rows = labelled(spark)
    w = sampling.sample_weights(df, "mort").collect()
    assert sum(r["weight"] for r in w) == pytest.approx(len(rows))
    labels, pats = np.array([r[1] for r in rows]), np.array([r[3] for r in rows])
    raw = np.array([0.8 * 1000 / (2 * (labels == a).sum()) + 0.2 * 1000 / (4 * (pats == b).sum()) for a, b in zip(labels, pats)])
    want = raw / raw.sum() * 1000
    assert {r["subject_id"]: r["weight"] for r in w} == pytest.approx(dict(enumerate(want)))
    some = sampling.sample_weights(df, "mort", allowed=[10]).collect()
    assert all((r["weight"] > 0) == (r["pattern_code"] == 10) for r in some)
    assert all(r["weight"] > 0 for r in sampling.sample_weights(df, "mort", allowed=[3]).collect())
    draws = sampling.weighted_sample(df, "mort").collect()
    assert len(draws) == 1000
    share = np.mean([labels[r["subject_id"]] for r in draws])
    assert share == pytest.approx(want[labels == 1].sum() / 1000, abs=0.06)
    assert sampling.weighted_sample(df, "mort", allowed=[10]).count() == (pats == 10).sum()


def test_curriculum(spark):
    df, rows = labelled(spark)
    assert [sampling.curriculum_stage(e, 100) for e in (30, 31, 70, 71)] == ["easy", "medium", "medium", "hard"]
    assert sampling.active_tasks(10, 100) == ("icu",)
    assert {r["pattern_code"] for r in sampling.allowed_patterns(df, 10, 100).collect()} == {15}
    assert {r["pattern_code"] for r in sampling.curriculum_subset(df, 50, 100).collect()} == {15, 14}
    rare = df.filter("pattern_code <> 15 OR subject_id < 20")
    assert sampling.curriculum_subset(rare, 10, 100).count() == rare.count()
    weights = {r["label"]: r for r in sampling.class_weights(df.withColumn("mort", F.lit(0)), "mort").collect()}
    assert weights[1]["weight"] is None and weights[0]["weight"] == 0.5


def test_epoch_log(spark):
    scores = [0.5, 0.6, 0.55] + [0.55] * 20
    log = spark.createDataFrame([(1, e + 1, t, s) for e, s in enumerate(scores) for t in ("readmission", "icu", "mortality")], "run long, epoch long, task string, auc double")
    best = training.best_epoch(log).first()
    assert (best["best_epoch"], best["stop_epoch"], best["epochs_run"]) == (2, 17, 17) and best["best_score"] == pytest.approx(0.6)
    w = {(r["epoch"], r["task"]): r["weight"] for r in training.adaptive_weights(log).collect()}
    assert w[(5, "icu")] == 1.0 and w[(7, "icu")] == pytest.approx(0.95) and w[(7, "mortality")] == pytest.approx(1.5 * 0.95)


def test_replicas_agree_with_in_row_average(spark):
    df = spark.createDataFrame([(1, [0.5, -0.2]), (2, [1.0, 2.0])], "id long, x array<double>")
    mean, prob = training.augmented_probability("x", "id", lambda v: v[0] * 2.0 + v[1], n=4)
    row = {r["id"]: (r["m"], r["p"]) for r in df.select("id", mean.alias("m"), prob.alias("p")).collect()}
    rep = training.replicate(df, "x", "id", n=4).withColumn("logit", F.col("x")[0] * 2.0 + F.col("x")[1])
    got = {r["id"]: (r["mean_logit"], r["probability"]) for r in training.average_replicas(rep, "id").collect()}
    for k in row:
        assert got[k] == pytest.approx(row[k])
    assert {r["logit"] for r in rep.filter("replica = 0 AND id = 1").collect()} == {0.8}


def test_losses_match_plain_formulas(spark):
    x, y = np.array([-40.0, -1.0, 0.0, 2.0, 40.0]), np.array([0, 1, 1, 0, 0])
    df = spark.createDataFrame([("mortality", float(a), float(b)) for a, b in zip(x, y)], "task string, logit double, label double")
    sp = np.logaddexp(0, x)
    ce = (1 - y) * sp + y * (sp - x)
    assert losses.bce_loss(df, weighted=()).first()["loss"] == pytest.approx(ce.mean())
    w = 5 / (2 * 2)
    assert losses.bce_loss(df).first()["loss"] == pytest.approx(((1 - y) * sp + w * y * (sp - x)).mean())
    fl = (1 - np.exp(-ce)) ** 3.75 * ce * 0.75
    assert losses.focal_loss(df, 0.5).first()["loss"] == pytest.approx(fl.mean())
    assert losses.focal_loss(df, 0.5, reduction="sum").first()["loss"] == pytest.approx(fl.sum())
    pair = df.select(F.sum(losses.focal("logit", "label", 2.0, (0.25, 0.75))).alias("v")).first()["v"]
    assert pair == pytest.approx(((1 - np.exp(-ce)) ** 2 * ce * np.where(y == 1, 0.75, 0.25)).sum())


def test_contrastive_batches_are_bounded(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, str(i % 3), rng.normal(size=4).tolist()) for i in range(70)], "id long, p string, v array<double>")
    b = losses.assign_batches(df, "id")
    assert sorted(r["count"] for r in b.groupBy("batch_id").count().collect()) == [6, 32, 32]
    rows = b.collect()
    got = {r["id"]: r for r in losses.contrastive_score(b, "id", "v", "p").collect()}
    for r in rows[:10]:
        mates = [o for o in rows if o["batch_id"] == r["batch_id"] and o["id"] != r["id"]]
        unit = lambda v: np.array(v) / np.linalg.norm(v)
        e = {o["id"]: math.exp(unit(r["v"]) @ unit(o["v"]) / 0.1) for o in mates}
        pos = sum(e[o["id"]] for o in mates if o["p"] == r["p"])
        assert got[r["id"]]["loss"] == pytest.approx(-math.log(pos / sum(e.values())))


def test_ridge_recovers_a_linear_map(spark):
    rng = np.random.default_rng(6)
    x, m = rng.normal(size=(120, 3)), rng.normal(size=(3, 2))
    rows = [(i, v.tolist(), (v @ m + 1).tolist() if i % 3 else [0.0, 0.0], 1, int(bool(i % 3))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>, fa int, fb int").repartition(5)
    out = {r["id"]: r["filled"] for r in models.impute_modality(df, "b", "fb", ["a"], ["fa"], ridge=1e-9, out="filled").collect()}
    for i, v in enumerate(x):
        assert out[i] == pytest.approx((v @ m + 1).tolist(), abs=1e-6)


def test_a_wrong_fit_leaves_a_residual(spark):
    rng = np.random.default_rng(7)
    rows = [(v.tolist() + [1.0], [float(v.sum()) + rng.normal(), 1.0]) for v in rng.normal(size=(200, 3))]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>").repartition(7)
    weights = models.fit_ridge(df, "x", "y", 0.5)
    left = models.ridge_residual(df, "x", "y", weights, 0.5).orderBy("pos").collect()
    assert all(r["residual"] < 1e-12 and r["n"] == 200 for r in left)
    assert [r["mean_value"] for r in left] == pytest.approx([float(np.mean([y[j] for _, y in rows])) for j in range(2)])
    assert min(r["residual"] for r in models.ridge_residual(df, "x", "y", weights + 0.1, 0.5).collect()) > 0.05
    with pytest.raises(ValueError):
        models.fit_ridge(df.limit(0), "x", "y")


def test_pattern_gradient_vanishes_at_the_fit_only(spark):
    rng = np.random.default_rng(9)
    rows = [(int(rng.choice([8, 10, 15])), rng.normal(size=2).tolist() + [1.0]) for _ in range(200)]
    df = spark.createDataFrame(rows, "pattern_code int, f array<double>")
    found = {r["pattern_code"]: r for r in models.pattern_gradient(df, "f", models.fit_pattern_classifier(df, "f")).collect()}
    assert set(found) == {8, 10, 15} and all(r["gradient"] < 1e-5 for r in found.values())
    assert all(r["mean_probability"] == pytest.approx(r["n"] / 200, abs=1e-5) for r in found.values())
    early = models.pattern_gradient(df, "f", models.fit_pattern_classifier(df, "f", max_iter=1)).collect()
    assert max(r["gradient"] for r in early) > 1e-3


def test_outcome_models_and_pattern_classifier(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        v = rng.normal(size=2)
        rows.append((i, v.tolist(), int(v[0] > 0), int(v[1] > 0), int(v[0] + v[1] > 0), 15 if v[0] > 0 else 8, 1, int(v[0] > 0), 1, 1, 1.0))
    df = spark.createDataFrame(rows, "subject_id long, features array<double>, readmission_30d int, icu_need_after_discharge_90d int, death_after_discharge_180d int, "
        "pattern_code int, has_struct int, has_img int, has_text int, has_rad int, weight double")
    pred = models.predict_outcomes(df, models.fit_outcome_models(df, "features", weight="weight"), "features")
    good = pred.filter((F.col("readmission_prediction") >= 0.5) == (F.col("readmission_target") == 1)).count()
    assert good > 280 and pred.first()["missing_pattern"] in ("1111", "1011")
    cls = models.classify_patterns(df, df, "features")
    assert cls.filter("pattern_code = predicted").count() > 280


def test_empty_and_one_class_inputs_do_not_divide_by_zero(spark):
    from modalframe.operators import metrics, pooling, rectifier

    none = spark.createDataFrame([("mortality", 0.3, 0.0)], "task string, logit double, label double")
    row = losses.bce_loss(none).first()
    assert row["pos_weight"] is None and row["loss"] == pytest.approx(math.log1p(math.exp(0.3)))
    empty = spark.createDataFrame([], "discharge_embedding string, radiology_embedding string")
    cov = pooling.embedding_coverage(empty).first()
    assert cov["n"] == 0 and cov["pct_text"] is None
    scores = spark.createDataFrame([], "score double, label double")
    assert metrics.ranking_metrics(scores).first()["auc"] is None and metrics.auc_and_brier(scores).first()["auc"] is None
    one = spark.createDataFrame([("t", "m", 0.5, 1.0, 1.0 if i == 0 else 0.0) for i in range(12)], "task string, modality string, p double, y double, w double")
    fit = rectifier.fit(one, "p", "y", weight="w").first()
    assert fit["var_delta"] == pytest.approx(0.1) and fit["n"] == 12
