"""Model, imputation and record-scan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.functions.numeric import round_to
from modalframe.functions.patterns import FLAGS
from modalframe.functions.vectors import vector_text
from modalframe.operators import models
from modalframe.operators.cohort import eligible_subjects
from modalframe.operators.heads import gradient_at
from modalframe.plans.predict import prepare_dataset, train_and_predict, with_flag_features
from modalframe.session import materialize
from modalframe.sources import records

from .q_cohort import wide as build_wide
from .q_dataset import DATASET, DS_VIEWS
from .q_vectors import E, EP, EXPLODED, FLAGGED, flags, four_modalities, long_form, r5
from .record_fixture import write_records
from .registry import query, r6, sql
from .views import view


def dataset(spark, sf_dir):
    wide = build_wide(spark, sf_dir)
    return prepare_dataset(wide, flags(spark, sf_dir))


@query("multitask_predict")
def multitask_predict(spark, sf_dir):
    return train_and_predict(dataset(spark, sf_dir))


@query("multitask_optimum", sql(DS_VIEWS, DATASET, " UNION ALL ".join(
    f"SELECT '{t}' AS task, count(*) AS n, CAST(sum({c}) AS BIGINT) AS positives, {r6(f'avg({c}::DOUBLE)')} AS mean_probability, TRUE AS settled FROM sp WHERE split = 'train'"
    for t, c in models.TASK_LABELS.items())))
def multitask_optimum(spark, sf_dir):
    """At the fitted heads the gradient vanishes; where it does, the mean probability of a head is the share of its positives."""
    train = with_flag_features(dataset(spark, sf_dir)).filter(F.col("split") == "train")
    train = materialize(train.select(*models.TASK_LABELS.values(), "features"), "train")
    heads = models.fit_outcome_models(train, "features")
    found = gradient_at(train, "features", models.TASK_LABELS, heads)
    return found.select("task", "n", "positives", round_to("mean_probability").alias("mean_probability"), (F.col("gradient") < 1e-7).alias("settled"))


@query("pattern_classifier")
def pattern_classifier(spark, sf_dir):
    data = materialize(dataset(spark, sf_dir).select("subject_id", "pattern_code", "split", "x_struct"), "pattern")
    return models.classify_patterns(data.filter(F.col("split") == "train"), data, "x_struct")


@query("modality_impute")
def modality_impute(spark, sf_dir):
    df = four_modalities(spark, sf_dir)
    filled = models.impute_modality(df, "x_img", "has_img", ["x_struct", "x_text", "x_rad"], ["has_struct", "has_text", "has_rad"], out="filled")
    return filled.select("vec_id", *FLAGS, vector_text("filled").alias("filled"))


@query("pattern_optimum", sql(DS_VIEWS, DATASET, """SELECT pattern_code, count(*) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM sp WHERE split = 'train'), 5) + 0.0 AS mean_probability,
 TRUE AS settled FROM sp WHERE split = 'train' GROUP BY pattern_code"""))
def pattern_optimum(spark, sf_dir):
    """At the fitted classifier the gradient vanishes; the mean probability of a pattern is then its share of the rows."""
    train = materialize(dataset(spark, sf_dir).filter(F.col("split") == "train").select("pattern_code", "x_struct"), "train")
    found = models.pattern_gradient(train, "x_struct", models.fit_pattern_classifier(train, "x_struct"))
    return found.select(F.col("pattern_code").cast("int"), "n", round_to("mean_probability", 5).alias("mean_probability"), (F.col("gradient") < 1e-4).alias("settled"))


@query("imputation_optimum", sql(EP, [EXPLODED, FLAGGED], f"""SELECT CAST(rpos AS INT) AS pos, count(*) AS n, {r5('avg(x)')} AS mean_value, TRUE AS settled
 FROM fl WHERE has_img = 1 GROUP BY rpos"""))
def imputation_optimum(spark, sf_dir):
    """At the fitted coefficients nothing is left of the normal equations; the mean of the fitted values is then the mean of the vectors."""
    df = four_modalities(spark, sf_dir).filter("has_img = 1")
    df = materialize(df.select("x_img", models.other_modalities(["x_struct", "x_text", "x_rad"], ["has_struct", "has_text", "has_rad"]).alias("x")), "ridge")
    found = models.ridge_residual(df, "x", "x_img", models.fit_ridge(df, "x", "x_img"))
    return found.select("pos", "n", round_to("mean_value", 5).alias("mean_value"), (F.col("residual") < 1e-9).alias("settled"))


_COHORT = """co AS (SELECT DISTINCT a.subject_id FROM v_admissions a JOIN v_patients p ON a.subject_id = p.subject_id
 WHERE p.anchor_year_group IN ('2008 - 2010', '2011 - 2013', '2014 - 2016', '2017 - 2019'))"""
_R = (*E, "v_admissions", "v_patients")


def scanned(spark, sf_dir):
    """The embeddings written as record files, scanned for the cohort; the files of all other subjects are never listed."""
    base = write_records(spark, view(spark, sf_dir, "v_image_embeddings"))
    return records.scan_records(spark, base, eligible_subjects(view(spark, sf_dir, "v_patients"), view(spark, sf_dir, "v_admissions")), bundle=16)


@query("record_scan", sql(_R, [_COHORT, EXPLODED], f"SELECT subject_id, 's' || study_id AS study_id, CAST(vec_id AS VARCHAR) AS file, CAST(pos AS INT) AS pos, {r5('x')} AS value FROM ex WHERE subject_id IN (SELECT subject_id FROM co)"))
def record_scan(spark, sf_dir):
    return long_form(records.readable(scanned(spark, sf_dir)), ["subject_id", "study_id", "file"], "embedding")


@query("record_scan_errors", sql(_R, [_COHORT], """SELECT subject_id, 's' || study_id AS study_id, vec_id || t.twin AS file, 'ValueError: corrupt record' AS error
 FROM v_image_embeddings, (VALUES ('-flipped', 1), ('-cut', 2)) t(twin, place) WHERE embedding[place] < 0 AND subject_id IN (SELECT subject_id FROM co)"""))
def record_scan_errors(spark, sf_dir):
    return scanned(spark, sf_dir).filter(F.col("error").isNotNull()).drop("embedding")
