"""Outcome labels from the admissions after the index discharge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import days_between
from .skew import salted_join

# Label names (the 90 and 180 days of two of them are names only, any later admission counts)
READMISSION, ICU, DEATH = "readmission_30d", "icu_need_after_discharge_90d", "death_after_discharge_180d"
LABELS = (READMISSION, ICU, DEATH)
READMISSION_DAYS = 30


def subsequent_admissions(admissions: DataFrame, index: DataFrame, horizon_days: int | None = None) -> DataFrame:
    """Admissions that start strictly after the subject's index discharge, with whole `days_from_index_discharge`."""
    discharge = index.select("subject_id", F.col("dischtime").alias("index_dischtime"))
    later = salted_join(
        admissions.select("subject_id", "hadm_id", "admittime", "hospital_expire_flag"), discharge, ["subject_id"], "hadm_id"
    ).filter(F.col("admittime") > F.col("index_dischtime"))
    later = later.withColumn(
        "days_from_index_discharge", F.floor(days_between("index_dischtime", "admittime")).cast("long")
    )
    return later if horizon_days is None else later.filter(F.col("days_from_index_discharge") <= horizon_days)


def assign_label(subjects: DataFrame, flagged: DataFrame, name: str) -> DataFrame:
    """`(subject_id, name)`: 1 for subjects in `flagged`, else 0."""
    hit = flagged.select("subject_id").distinct().withColumn(name, F.lit(1))
    return subjects.select("subject_id").join(hit, "subject_id", "left").select(
        "subject_id", F.coalesce(F.col(name), F.lit(0)).alias(name)
    )


def readmission_label(subjects: DataFrame, subsequent: DataFrame, days: int = READMISSION_DAYS) -> DataFrame:
    return assign_label(subjects, subsequent.filter(F.col("days_from_index_discharge") <= days), READMISSION)


def death_label(subjects: DataFrame, subsequent: DataFrame) -> DataFrame:
    return assign_label(subjects, subsequent.filter(F.col("hospital_expire_flag") == 1), DEATH)


def icu_subjects(subsequent: DataFrame, icustays: DataFrame) -> DataFrame:
    """Subjects with an ICU stay in one of the later admissions, matched by admission id."""
    stays = icustays.select("subject_id", "hadm_id").distinct()
    return stays.join(subsequent.select("hadm_id").distinct(), "hadm_id", "left_semi").select("subject_id")


def icu_label(subjects: DataFrame, subsequent: DataFrame, icustays: DataFrame) -> DataFrame:
    return assign_label(subjects, icu_subjects(subsequent, icustays), ICU)


def all_labels(
    subjects: DataFrame, admissions: DataFrame, index: DataFrame, icustays: DataFrame, horizon_days: int | None = None
) -> DataFrame:
    """The three labels side by side, from one pass over the later admissions and one aggregation.

    An admission id belongs to one subject, so the ICU stays are reduced to their admission ids before they meet it.
    """
    stays = icustays.select("hadm_id").distinct().withColumn("_icu", F.lit(1))
    later = subsequent_admissions(admissions, index, horizon_days).join(stays, "hadm_id", "left")
    flags = later.groupBy("subject_id").agg(
        F.max((F.col("days_from_index_discharge") <= READMISSION_DAYS).cast("int")).alias(READMISSION),
        F.max(F.coalesce(F.col("hospital_expire_flag") == 1, F.lit(False)).cast("int")).alias(DEATH),
        F.max("_icu").alias(ICU),
    )
    joined = subjects.select("subject_id").join(flags, "subject_id", "left")
    return joined.select("subject_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in LABELS])


def label_distribution(labels: DataFrame, columns=LABELS) -> DataFrame:
    """`(label, n_positive, n, rate)`, one row per label."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("y")) for c in columns])).alias("s")
    return labels.select(items).groupBy("s.label").agg(
        F.sum("s.y").alias("n_positive"), F.count(F.lit(1)).alias("n"), F.avg("s.y").alias("rate")
    )
