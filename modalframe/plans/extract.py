"""Stage 0: the cohort's ids and every source table restricted to them; dictionaries whole."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.cohort import eligible_subjects
from ..session import materialize
from ..sources.tables import path_exists, read_csv_tolerant, read_dictionaries, read_table
from .cohort import DETAIL_TABLES

TABLES = ("patients", "admissions", *DETAIL_TABLES)
DICTIONARIES = ("d_icd_diagnoses", "d_icd_procedures", "d_labitems")
# Types of columns that are not text, by name
TYPES = {
    "subject_id": T.LongType(), "hadm_id": T.LongType(), "stay_id": T.LongType(), "itemid": T.LongType(), "labevent_id": T.LongType(),
    "microevent_id": T.LongType(), "transfer_id": T.LongType(), "anchor_age": T.IntegerType(), "hospital_expire_flag": T.IntegerType(),
    "los": T.DoubleType(), "totalamount": T.DoubleType(), "value": T.DoubleType(), "drg_severity": T.IntegerType(),
    "admittime": T.TimestampType(), "dischtime": T.TimestampType(), "transfertime": T.TimestampType(),
}


@dataclass
class Extract:
    """`tables` and `subjects` are ready to be stored; `rejected` has unparsable lines; `skipped` says why a source is absent."""

    subjects: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    rejected: dict[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)


def csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Names from the header line, types by name, text otherwise."""
    names = spark.read.csv(path, header=True, quote='"', escape="\\").columns
    return T.StructType([T.StructField(n, TYPES.get(n, T.StringType())) for n in names])


def extract(spark: SparkSession, source: str, tables: Sequence[str] = TABLES, dictionaries: Sequence[str] = DICTIONARIES, csv: bool = False) -> Extract:
    """Needs `patients` and `admissions`; other missing sources are skipped and reported.

    Each table meets the ids in one semi-join; the ids are stored first, so the cohort is selected once.
    """
    root = source.rstrip("/")
    suffix = ".csv" if csv else ""
    rejected: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        path = f"{root}/{name}{suffix}"
        if not csv:
            return read_table(spark, path)
        rows, rejected[name] = read_csv_tolerant(spark, path, csv_schema(spark, path))
        return rows

    there = [n for n in tables if path_exists(spark, f"{root}/{n}{suffix}")]
    skipped = {n: "no such source" for n in tables if n not in there}
    for needed in ("patients", "admissions"):
        if needed not in there:
            raise FileNotFoundError(f"{root}/{needed}{suffix}")
    read_tables = {n: read(n) for n in there}
    subjects = materialize(eligible_subjects(read_tables["patients"], read_tables["admissions"]), "subjects")
    kept = {n: df.join(subjects, "subject_id", "left_semi") for n, df in read_tables.items()}
    if csv:
        for n in dictionaries:
            if path_exists(spark, f"{root}/{n}{suffix}"):
                kept[n] = read(n)
            else:
                skipped[n] = "no such source"
    else:
        found, failed = read_dictionaries(spark, {n: f"{root}/{n}" for n in dictionaries})
        kept |= found
        skipped |= failed
    return Extract(subjects, kept, rejected, skipped)
