"""Stage 1: cohort, index admission, labels, per-admission aggregates, one wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cohort, features, labels
from ..operators.ordered import null_safe_join
from ..session import materialize
from ..sources.bucketed import KeyedTables, write_bucketed

DETAIL_TABLES = (
    "diagnoses_icd", "procedures_icd", "drgcodes", "labevents", "microbiologyevents", "prescriptions", "emar", "services",
    "transfers", "icustays", "chartevents", "datetimeevents", "inputevents", "outputevents",
)
PATIENT_CATEGORICALS = ("gender", "anchor_year_group")


def require(df: DataFrame, columns, what: str) -> DataFrame:
    """Fail early when a column is missing or the relation is empty."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def build_features(
    tables: dict[str, DataFrame], subjects: DataFrame | None = None, mode: str = "row", fill: bool = True, categories: dict[str, list[str]] | None = None, buckets: int | None = None,
    shared: features.SharedRows | None = None,
) -> DataFrame:
    """One row per cohort subject: index features, three labels, patient one-hots and all detail aggregates.

    `fill=False` keeps gaps as NULL, for imputation later. `buckets` says that all tables are bucketed by subject into so many.
    `shared` says that the detail tables are drawn from one relation: it meets the index admissions once, in place of every table on its own.
    """
    patients, admissions = tables["patients"], tables["admissions"]
    if subjects is None:
        subjects = cohort.eligible_subjects(patients, admissions)
    subjects = subjects.select("subject_id")
    stays = cohort.restrict_to_subjects(admissions, subjects, spread_by="hadm_id")
    pairs = cohort.index_pairs(stays) if mode == "row" else None
    if shared and pairs is not None:
        # stored, so that the joins know how few they are: whole admissions need not move to find the first of each subject (of these subjects alone)
        pairs = materialize(pairs, "index_pairs")
        index = cohort.index_admission(null_safe_join(admissions, pairs, features.PAIR, "left_semi"))
    else:
        index = cohort.index_admission(stays, mode)
    outcome = labels.all_labels(subjects, stays, index, tables["icustays"])
    people = features.one_hot(
        patients.select("subject_id", "gender", "anchor_age", "anchor_year_group"), PATIENT_CATEGORICALS, categories
    )
    first = index.select("subject_id", "hadm_id", *[F.col(c).alias(f"idx_{c}") for c in cohort.INDEX_FEATURES])
    base = subjects.join(first, "subject_id", "left").join(outcome, "subject_id", "left").join(people, "subject_id", "left")
    pairs = index.select(*features.PAIR) if pairs is None else pairs
    there = {t: tables[t] for t in DETAIL_TABLES if t in tables}
    if buckets:
        pairs = write_bucketed(pairs.filter(F.col("hadm_id").isNotNull()), "subject_id", buckets)
        details = features.colocated_frame(there, pairs).withColumnRenamed("hadm_id", "_h")
        # one pair a subject, the index admission of `first`: the subject alone is key enough
        wide = base.join(details, "subject_id", "left").drop("hadm_id", "_h")
    else:
        # drawn from rows of index admissions, the tables need not meet the pairs again
        details = features.combined_frame(features.shared_at_index(shared, pairs)) if shared else features.combined_frame(there, pairs)
        wide = base.join(details, features.PAIR, "left").drop("hadm_id")
    return features.fill_missing(wide) if fill else wide


def features_of_snapshot(stored: KeyedTables, mode: str = "row", fill: bool = True) -> DataFrame:
    """`build_features` over tables stored by subject. Rows of the detail tables are joined and aggregated in their buckets; hot
    subjects, which lie apart, take the plain way, and the two results have no subject in common."""
    if stored.key != "subject_id":
        raise ValueError(f"tables are stored by {stored.key!r}, not by subject_id")
    found = features.categories_of(stored.table("patients"), PATIENT_CATEGORICALS)
    wide = build_features(stored.tables, mode=mode, fill=fill, categories=found, buckets=stored.buckets)
    if not stored.hot:
        return wide
    return wide.unionByName(build_features(stored.hot, mode=mode, fill=fill, categories=found))


def label_report(wide: DataFrame) -> DataFrame:
    return labels.label_distribution(wide.select("subject_id", *[F.col(c) for c in labels.LABELS]))
