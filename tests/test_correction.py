"""The full correction against an array implementation of the documented rules on a small table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalframe.operators import correction as K
from modalframe.session import small_methods

from test_metrics import brute_auc
from test_rectifier import rules


def fixture(seed=3):
    rng = np.random.default_rng(seed)
    sizes = {"1110": 240, "1010": 150, "1000": 80, "1001": 15, "1101": 6, "1111": 25}
    pattern = np.repeat(list(sizes), list(sizes.values()))
    n = len(pattern)
    readm, icu = rng.random(n), rng.random(n)
    bias = np.where(pattern == "1010", 0.25, np.where(pattern == "1000", -0.2, 0.02))
    y_readm = (rng.random(n) < np.clip(readm * 0.8 + bias, 0, 1)).astype(int)
    y_icu = (rng.random(n) < np.clip(icu * 0.9 - bias, 0, 1)).astype(int)
    return pattern, readm, icu, y_readm, y_icu


def ranked(p, d):
    q = p - 0.7 * d
    side = np.sign(q - 0.5)
    zone = np.where(np.abs(q - 0.5) < 0.05, q + 0.07 * side, q - 0.05 * side)
    return np.clip(np.where((q >= 0.4) & (q <= 0.6), zone, q), 0, 1)


def adaptive(p, delta):
    theta, s = p.mean(), p.std(ddof=1)
    d = delta * 1.2
    cap = lambda d, share: share * theta * np.sign(d) if abs(d / max(0.01, theta)) > share else d
    if s > 0.25:
        d *= max(0.3, 0.7 - (s - 0.25))
    d = cap(d, 0.15)
    if s > 0.3:
        d *= max(0.4, 0.8 - (s - 0.3))
    d = cap(d, 0.2)
    return theta - 0.01 if theta - d < 0 else theta - 0.99 if theta - d > 1 else d


def expected(selective):
    pattern, r0, i0, yr, yi = fixture()
    groups = {p: pattern == p for p in np.unique(pattern)}

    def quality(p):
        m = groups[p]
        auc = brute_auc(yr[m], r0[m])
        auc = min(auc, 0.9) if m.sum() < 200 else auc
        return 0.6 * auc + 0.3 * min(1, m.sum() / 200) + 0.1 * p.count("1") / 4

    reference = max((p for p in groups if groups[p].sum() >= 60), key=quality)
    fitted = [p for p in groups if p != reference and groups[p].sum() >= 20]
    dr = {p: rules(r0[groups[p]] - yr[groups[p]], groups[p].sum())[0] for p in fitted}
    di = {p: rules(i0[groups[p]] - yi[groups[p]], groups[p].sum())[0] for p in fitted}
    shift_i = sum((groups[p] * di[p] for p in fitted), np.zeros(len(r0)))
    shift_r = sum((groups[p] * dr[p] for p in fitted), np.zeros(len(r0)))
    r, i, tables, aucs = r0.copy(), i0.copy(), [], []
    for k in range(5):
        r, i = r.copy(), i.copy()
        for p in fitted:
            m = groups[p]
            c = ranked(r[m], dr[p])
            gain = brute_auc(yr[m], c) - brute_auc(yr[m], r[m])
            w = 0.9 if gain > 0 else None if selective else 0.3 if abs(gain) < 0.005 else 0.1
            if w:
                extra = np.select([(c > 0.4) & (c < 0.6), (c > 0.7) & (yr[m] == 0), (c < 0.3) & (yr[m] == 1)], [0.05 * np.sign(c - 0.5), -0.1, 0.1], 0.0)
                r[m] = np.clip(w * c + (1 - w) * r[m] + 0.3 * extra, 0.001, 0.999)
            base, weights, boost = K.STRENGTH["icu"]
            factor = (base + sum(x for x, bit in zip(weights, p) if bit == "0")) * boost.get(p, 1.0)
            q = i[m] - adaptive(i[m], di[p]) / (1 + 0.15 * k) * factor * 1.5
            q = np.where((q >= 0.45) & (q <= 0.55), q - 0.07 * np.sign(q - 0.5), q)
            q = np.where((q > 0.8) & (yi[m] == 0), q - 0.15, q)
            q = np.clip(np.where((q < 0.2) & (yi[m] == 1), q + 0.15, q), 0.001, 0.999)
            gain = brute_auc(yi[m], q) - brute_auc(yi[m], i[m])
            better = ((i[m] - yi[m]) ** 2).mean() - ((q - yi[m]) ** 2).mean()
            if not selective or gain > -0.0005 or better > 0.001:
                w = min(0.95, 0.85 + 3 * gain) if gain > 0 else 0.4 if better > 0 and abs(gain) < 0.005 else 0.2
                i[m] = w * q + (1 - w) * i[m]
        errors = i0 + np.select([(i0 > 0.8) & (yi == 0), (i0 < 0.2) & (yi == 1)], [-0.2, 0.2], 0.0)
        mixed = np.clip(0.5 * i + 0.2 * (i0 - 0.2 * shift_i) + 0.2 * (i0 - 1.05 * shift_i) + 0.1 * errors, 0, 1)
        if brute_auc(yi, mixed) > brute_auc(yi, i):
            i = mixed
        tables.append((r, i))
        aucs.append(brute_auc(yr, r))
        if k and aucs[-1] < 0.999 * aucs[-2]:
            r, i = tables[-2]
            break
    rank = r0.copy()
    for p in fitted:
        rank[groups[p]] = ranked(r0[groups[p]], dr[p])
    mixed = np.clip(0.6 * r + 0.15 * (r0 - 0.2 * shift_r) + 0.15 * (r0 - 0.78 * shift_r) + 0.1 * rank, 0, 1)
    if brute_auc(yr, mixed) > brute_auc(yr, r):
        return reference, mixed, i, aucs
    best = int(np.argmax(aucs))
    return reference, *tables[best], aucs


def frame(spark):
    pattern, r, i, yr, yi = fixture()
    rows = [(k, float(r[k]), int(yr[k]), float(i[k]), int(yi[k]), *[int(c) for c in pattern[k]]) for k in range(len(r))]
    return spark.createDataFrame(rows, "subject_id long, readmission_prediction double, readmission_target int, icu_prediction double, icu_target int, "
        "has_struct int, has_img int, has_text int, has_rad int")


@pytest.mark.parametrize("selective", [False, True])
def test_full_correction(spark, selective):
    reference, readm, icu, aucs = expected(selective)
    done = K.correct_predictions(frame(spark), selective)
    assert done.reference == reference
    assert [h["readm_auc"] for h in done.history] == pytest.approx(aucs)
    rows = done.rows.orderBy("subject_id").collect()
    assert [r["readm_pred_corrected"] for r in rows] == pytest.approx(readm.tolist())
    assert [r["icu_pred_corrected"] for r in rows] == pytest.approx(icu.tolist())
    status = {r["status"] for r in rows}
    assert status == {"reference", "corrected", "unfitted", "too_small"}
    compared = {(r["task"], r["metric"]): r for r in done.metrics().collect()}
    assert len(compared) == 6 and compared[("readmission", "auc")]["delta"] == pytest.approx(brute_auc(fixture()[3], readm) - brute_auc(fixture()[3], fixture()[1]))


def test_no_reference_returns_input(spark):
    few = frame(spark).filter("subject_id < 40")
    done = K.correct_predictions(few)
    assert done.reference is None
    rows = done.rows.collect()
    assert {r["status"] for r in rows} == {"no_reference"} and all(r["readm_pred_original"] == r["readm_pred_corrected"] for r in rows)


def test_labels_can_be_left_out(spark):
    flipped = frame(spark).withColumn("subject_id", F.col("subject_id"))
    state = K.prepare(flipped)
    ref = spark.createDataFrame([("1110",)], "pattern string")
    params = K.pattern_parameters(state, "1110", K.fit_rectifiers(state, ref))
    a = K.candidates(state, params, use_labels=False).filter("status = 'corrected'")
    b = K.candidates(state.withColumn("y_icu", 1 - F.col("y_icu")), params, use_labels=False).filter("status = 'corrected'")
    assert a.agg(F.sum("c_icu")).first()[0] == pytest.approx(b.agg(F.sum("c_icu")).first()[0])


def test_single_class_pattern_is_left_alone(spark):
    df = frame(spark).withColumn("readmission_target", F.when(F.col("has_img") + F.col("has_text") == 0, 0).otherwise(F.col("readmission_target")))
    done = K.correct_predictions(df, max_iterations=1)
    assert done.rows.filter(F.col("readm_pred_corrected").isNull()).count() == 0


def test_interrupted_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    """A run lost in its third iteration leaves two; the next one computes only what is missing, with the same result."""
    whole = K.correct_predictions(frame(spark), True)
    folder, calls, blend = f"{tmp_path}/run", [], K.blend

    def counted(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("driver lost")
        return blend(*args)

    monkeypatch.setattr(K, "blend", counted)
    with pytest.raises(RuntimeError, match="driver lost"):
        K.correct_predictions(frame(spark), True, folder=folder)
    again = K.correct_predictions(frame(spark), True, folder=folder)
    assert again.history == whole.history and again.best_iteration == whole.best_iteration
    assert sorted(map(tuple, again.rows.collect())) == sorted(map(tuple, whole.rows.collect()))
    assert len(calls) == len(whole.history) + 1  # the first iteration once, the failed one twice
    monkeypatch.setattr(K, "blend", None)  # a finished run needs no more work
    assert K.correct_predictions(frame(spark), True, folder=folder).history == whole.history
    with pytest.raises(ValueError, match="other settings"):
        K.correct_predictions(frame(spark), False, folder=folder)


def test_metrics_from_one_counting(spark):
    from modalframe.operators.metrics import auc_and_brier, stack_scores

    state = K.prepare(frame(spark))
    found = K.pattern_metrics(state, K.NOW)
    for part in ([], ["pattern"]):
        for r in auc_and_brier(stack_scores(state, K.NOW, part), [*part, "task"]).collect():
            got = found[(r["pattern"] if part else K.EVERY, r["task"])]
            assert got == pytest.approx((r["auc"], r["brier"]), nan_ok=True) if r["auc"] is not None else got[0] is None


def test_iterations_do_not_shuffle_rows_by_pattern(spark):
    """The tables of patterns are broadcast although their size is not known, so no task takes in all rows of a pattern."""
    pattern, readm, icu, y_readm, y_icu = fixture()
    rows = [(i, str(p), float(a), float(b), float(c), float(d), float(c), float(d)) for i, (p, a, b, c, d) in enumerate(zip(pattern, y_readm, y_icu, readm, icu))]
    state = spark.createDataFrame(rows, "id long, pattern string, y_readm double, y_icu double, readm0 double, icu0 double, readm double, icu double")
    params = spark.createDataFrame([("1010", 0.1, -0.1, 0.05, 150, "corrected"), ("1110", None, None, None, 240, "reference")], K._PARAM_SCHEMA)
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "-1")
    try:
        cand = K.candidates(state, params)
        plan = K.blend(cand, K.gates(cand, False))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_large_methods_are_avoided_in_the_correction_only(spark):
    setting = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(setting)
    with pytest.raises(ZeroDivisionError), small_methods(spark):
        assert int(spark.conf.get(setting)) <= 8000
        1 / 0
    assert spark.conf.get(setting) == before
