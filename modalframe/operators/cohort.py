"""Cohort selection and index admissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import days_between
from .skew import salted_join

# The year groups that make a subject eligible, and the admission columns kept as index features
ELIGIBLE_YEAR_GROUPS = ("2008 - 2010", "2011 - 2013", "2014 - 2016", "2017 - 2019")
INDEX_FEATURES = (
    "admission_type", "insurance", "race", "los", "admission_location", "discharge_location", "hospital_expire_flag",
)


def eligible_subjects(
    patients: DataFrame, admissions: DataFrame, year_groups: Sequence[str] = ELIGIBLE_YEAR_GROUPS
) -> DataFrame:
    """Distinct subjects of an eligible year group with at least one admission, ordered by id."""
    eligible = patients.filter(F.col("anchor_year_group").isin(*year_groups)).select("subject_id")
    admitted = admissions.select("subject_id").distinct()
    return admitted.join(eligible, "subject_id", "left_semi").orderBy("subject_id")


def restrict_to_subjects(df: DataFrame, ids: DataFrame, limit: int | None = None, spread_by: str | None = None) -> DataFrame:
    """Rows of `df` whose subject is in `ids`; `limit` (falsy = none) caps the scan.

    Pass `spread_by`, a column that varies within a subject, when single subjects may be very large.
    """
    wanted = ids.select("subject_id")
    if spread_by:
        kept = salted_join(df, wanted.distinct(), ["subject_id"], spread_by, "left_semi")
    else:
        kept = df.join(wanted, "subject_id", "left_semi")
    return kept.limit(limit) if limit else kept


def with_los(admissions: DataFrame) -> DataFrame:
    return admissions.withColumn("los", days_between("admittime", "dischtime"))


def index_admission(admissions: DataFrame, mode: str = "row") -> DataFrame:
    """First admission per subject by (admittime, hadm_id), NULL times last; adds `los`.

    `row` takes that row as it is. `first_non_null` takes, column by column, the first value that is not NULL.
    An aggregation, not a window: it combines map-side, so no subject is ever sorted in one task.
    """
    df = with_los(admissions)
    key = F.struct(F.col("admittime").isNull(), F.col("admittime"), F.col("hadm_id"))
    cols = [c for c in df.columns if c != "subject_id"]
    if mode == "row":
        first = df.groupBy("subject_id").agg(F.min_by(F.struct(*cols), key).alias("_r"))
        return first.select("subject_id", *[F.col("_r")[c].alias(c) for c in cols])
    if mode == "first_non_null":
        return df.groupBy("subject_id").agg(
            *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(c) for c in cols]
        )
    raise ValueError(f"mode must be 'row' or 'first_non_null', got {mode!r}")


def index_pairs(admissions: DataFrame) -> DataFrame:
    """`(subject_id, hadm_id)` of each subject's index admission: one aggregation that carries nothing else."""
    key = F.struct(F.col("admittime").isNull(), F.col("admittime"), F.col("hadm_id"))
    return admissions.groupBy("subject_id").agg(F.min_by("hadm_id", key).alias("hadm_id"))


def index_features(index: DataFrame, columns: Sequence[str] = INDEX_FEATURES) -> DataFrame:
    return index.select("subject_id", *[F.col(c).alias(f"idx_{c}") for c in columns])
