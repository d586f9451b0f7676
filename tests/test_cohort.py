import datetime as dt

import pytest
from pyspark.sql import functions as F

from modalframe.operators import cohort as C
from modalframe.operators import features as X
from modalframe.operators import labels as L
from modalframe.plans.cohort import build_features, require

ADM = "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, insurance string, hospital_expire_flag int"


def day(d, h=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=d, hours=h)


def admissions(spark, rows):
    return spark.createDataFrame([(s, h, a, d, None, i, e) for s, h, a, d, i, e in rows], ADM)


def test_index_admission_modes(spark):
    df = admissions(spark, [(1, 12, day(5), day(6), "b", 0), (1, 11, day(5), day(7), None, 0), (1, 10, None, day(9), "z", 0)])
    row = C.index_admission(df).first()
    assert (row["hadm_id"], row["insurance"], row["los"]) == (11, None, 2.0)
    assert C.index_admission(df, "first_non_null").first()["insurance"] == "b"
    with pytest.raises(ValueError):
        C.index_admission(df, "last")


def test_los_is_fractional(spark):
    df = admissions(spark, [(1, 1, day(0), day(1, 12), "a", 0)])
    assert C.with_los(df).first()["los"] == 1.5


def test_labels_at_their_limits(spark):
    rows = [
        (1, 1, day(0), day(1), "a", 0), (1, 2, day(1), day(2), "a", 1),  # starts exactly at discharge: not later
        (2, 3, day(0), day(1), "a", 0), (2, 4, day(32) - dt.timedelta(seconds=1), day(33), "a", 0),  # 30 whole days
        (3, 5, day(0), day(1), "a", 0), (3, 6, day(32), day(33), "a", 1),  # 31 days, death
        (4, 7, day(0), day(1), "a", 0),
    ]
    adm = admissions(spark, rows)
    index = C.index_admission(adm)
    icu = spark.createDataFrame([(3, 6, 1, 1.0), (3, 6, 2, 1.0), (4, 7, 3, 2.0)], "subject_id long, hadm_id long, stay_id long, los double")
    got = {r["subject_id"]: tuple(r[c] for c in L.LABELS) for r in L.all_labels(index, adm, index, icu).collect()}
    assert got == {1: (0, 0, 0), 2: (1, 0, 0), 3: (0, 1, 1), 4: (0, 0, 0)}
    later = L.subsequent_admissions(adm, index)
    single = {r["subject_id"]: r["readmission_30d"] for r in L.readmission_label(index, later).collect()}
    assert single == {1: 0, 2: 1, 3: 0, 4: 0}
    short = {r["subject_id"]: r[L.DEATH] for r in L.all_labels(index, adm, index, icu, horizon_days=30).collect()}
    assert short[3] == 0


def test_hot_subject_semi_join_keeps_all_rows(spark):
    df = spark.range(900).selectExpr("CASE WHEN id < 600 THEN 7 ELSE id END AS subject_id", "id AS k")
    ids = spark.createDataFrame([(7,), (700,), (700,)], "subject_id long")
    assert C.restrict_to_subjects(df, ids, spread_by="k").count() == 601
    assert C.restrict_to_subjects(df, ids, limit=5).count() == 5
    assert C.restrict_to_subjects(df, ids, limit=0).count() == 601


def tables(spark):
    pair = "subject_id long, hadm_id long"
    make = spark.createDataFrame
    return {
        "diagnoses_icd": make([(1, 10, "a"), (1, 10, "a"), (1, 10, None), (1, 99, "b"), (2, 20, None)], pair + ", icd_code string"),
        "drgcodes": make([(1, 10, None, 2.0), (1, 10, "x", 1.0), (1, 10, "x", None)], pair + ", drg_code string, drg_severity double"),
        "labevents": make([(1, 10, 1, None), (1, 10, 2, "NORMAL"), (1, 10, 3, "abnormal"), (1, None, 4, "abnormal")], pair + ", labevent_id long, flag string"),
        "prescriptions": make([(1, 10, "p", "ANTIBIOTIC"), (1, 10, None, "antibiotic")], pair + ", poe_id string, drug_type string"),
        "emar": make([(1, 10, "q", "x ANTIBIOTIC"), (1, 10, "r", None)], pair + ", poe_id string, event_txt string"),
        "icustays": make([(1, 10, 5, None)], pair + ", stay_id long, los double"),
        "inputevents": make([(1, 10, 2.5)], pair + ", totalamount double"),
        "outputevents": make([(2, 20, 4.0)], pair + ", value double"),
    }


def test_feature_frames_and_combined_frame_agree(spark):
    pairs = spark.createDataFrame([(1, 10), (2, 20)], "subject_id long, hadm_id long")
    frames = X.feature_frames(tables(spark), pairs)
    one = {k: {r["subject_id"]: r.asDict() for r in f.collect()} for k, f in frames.items()}
    assert (one["diagnoses_icd"][1]["idx_dx_count"], one["diagnoses_icd"][1]["idx_unique_dx"]) == (2, 1)
    assert (one["drgcodes"][1]["idx_drg_count"], one["drgcodes"][1]["idx_severity_mode"]) == (3, 1.0)
    assert (one["labevents"][1]["idx_lab_count"], one["labevents"][1]["idx_lab_abn"]) == (3, 1)
    assert (one["medications"][1]["idx_med_count"], one["medications"][1]["idx_med_abx"]) == (3, 2)
    assert (one["icustays"][1]["idx_icu_flag"], one["icustays"][1]["idx_icu_los"]) == (1, 0.0)
    assert one["fluids"][1]["idx_net_fluid"] == 2.5 and one["fluids"][2]["idx_net_fluid"] == -4.0
    both = {r["subject_id"]: r.asDict() for r in X.combined_frame(tables(spark)).join(pairs, X.PAIR).collect()}
    for frame in one.values():
        for subject, values in frame.items():
            for column, value in values.items():
                assert both[subject][column] == value, (subject, column)


def test_one_hot_and_fill(spark):
    df = spark.createDataFrame([(1, "b", None, 1.0), (2, None, "u", float("nan")), (3, "a", "u", None)], "subject_id long, g string, h string, x double")
    hot = X.one_hot(df, ["g"])
    assert hot.columns == ["subject_id", "h", "x", "g_a", "g_b", "g_nan"]
    rows = {r["subject_id"]: r for r in X.fill_missing(hot).collect()}
    assert (rows[1]["g_b"], rows[2]["g_nan"], rows[1]["h"], rows[2]["x"], rows[3]["x"]) == (1, 1, "", 0.0, 0.0)
    with pytest.raises(ValueError):
        X.categories_of(df, ["g"], max_categories=1)


def test_require(spark):
    df = spark.createDataFrame([(1,)], "a long")
    assert require(df, ["a"], "x") is df
    with pytest.raises(ValueError):
        require(df, ["b"], "x")
    with pytest.raises(ValueError):
        require(df.filter("a > 1"), ["a"], "x")


def test_shared_rows_meet_the_pairs_once(spark, monkeypatch):
    """Tables drawn from one relation give the same features, from the rows of the index admissions alone."""
    ids = spark.range(600).select(
        F.when(F.col("id") % 41 != 0, F.col("id") % 30).alias("subject_id"), (F.col("id") % 90).alias("hadm_id"), F.col("id").alias("n"), (F.col("id") % 7).cast("double").alias("v")
    )

    def tables(rows):
        lost = F.when(F.col("n") % 5 != 0, F.col("hadm_id")).alias("hadm_id")
        return {
            "diagnoses_icd": rows.select(*X.PAIR, F.concat(F.lit("c"), F.col("n") % 4).alias("icd_code")), "drgcodes": rows.where("n % 2 = 0").select(*X.PAIR, F.lit("x").alias("drg_code"), F.col("v").alias("drg_severity")),
            "labevents": rows.select("subject_id", lost, F.col("n").alias("labevent_id"), F.lit("abnormal").alias("flag")), "icustays": rows.where("n % 3 = 0").select(*X.PAIR, F.col("n").alias("stay_id"), F.col("v").alias("los")),
            "inputevents": rows.select(*X.PAIR, F.col("v").alias("totalamount")), "outputevents": rows.where("n < 300").select(*X.PAIR, F.col("v").alias("value")),
        }

    stays = [(s, 30 * k + s, day(k * 40 + (2 if s % 2 else 0)), day(k * 40 + 3), "a", k) for s in range(29) for k in (2, 1, 0)]
    columns = ("admission_type", "race", "admission_location", "discharge_location")
    people = spark.range(29).selectExpr("id AS subject_id", "'F' AS gender", "40 AS anchor_age", "'2008 - 2010' AS anchor_year_group")
    both = {"patients": people, "admissions": admissions(spark, stays).withColumns({c: F.lit("t") for c in columns}), **tables(ids)}
    seen = []
    plain = build_features(both)
    kept = X.at_index
    monkeypatch.setattr(X, "at_index", lambda rows, pairs: seen.append(pairs) or kept(rows, pairs))
    shared = build_features(both, shared=X.SharedRows(ids, tables))
    assert sum(p is not None for p in seen) == 1
    assert sorted(map(str, shared.collect())) == sorted(map(str, plain.select(shared.columns).collect())) and shared.agg(F.sum("idx_lab_count")).first()[0] > 50


def test_rows_joined_with_admissions_meet_the_index_admissions_alone(spark):
    """Rows that are a join with admissions: only index admissions get to the join, repeated and null keys as in the plain way."""
    stays = [(s, None if s == 5 and not k else 30 * k + s, day(k * 40 + (2 if s % 2 else 0)), day(k * 40 + 3), "a", k) for s in [*range(12), 7] for k in (2, 1, 0)]
    stays += [(None, 500, day(1), day(2), "a", 0), (3, None, day(90), day(95), "a", 1)]
    columns = ("admission_type", "race", "admission_location", "discharge_location")
    people = spark.range(11).selectExpr("id AS subject_id", "'F' AS gender", "40 AS anchor_age", "'2008 - 2010' AS anchor_year_group")
    given = {"patients": people, "admissions": admissions(spark, stays).withColumns({c: F.lit("t") for c in columns})}
    lines = spark.range(400).select((F.col("id") % 80).alias("line_hadm"), F.col("id").alias("n"), (F.col("id") % 7).cast("double").alias("v"))
    pairs, met = given["admissions"].select(*X.PAIR), []

    def joined(at):
        met.append(at.groupBy(*X.PAIR).count().collect())
        return lines.join(at, F.col("line_hadm") == F.col("hadm_id")).drop("line_hadm")

    def tables(rows):
        return {
            "diagnoses_icd": rows.select(*X.PAIR, F.concat(F.lit("c"), F.col("n") % 4).alias("icd_code")), "drgcodes": rows.select(*X.PAIR, F.lit("x").alias("drg_code"), F.col("v").alias("drg_severity")),
            "icustays": rows.where("n % 3 = 0").select(*X.PAIR, F.col("n").alias("stay_id"), F.col("v").alias("los")),
        }

    every = joined(pairs)
    plain = build_features(given | tables(every))
    shared = build_features(given | tables(every), shared=X.SharedRows(every, tables, pairs, joined))
    assert sorted(map(str, shared.collect())) == sorted(map(str, plain.select(shared.columns).collect()))
    assert sorted((r.subject_id, r.hadm_id, r["count"]) for r in met[1]) == [(s, s, 2 if s == 7 else 1) for s in range(11) if s != 5]
