"""spark-submit jobs/cohort.py --tables DIR --out DIR: cohort ids, wide feature table and label report."""

from __future__ import annotations

import argparse

from _common import get_spark

from modalframe.operators.cohort import eligible_subjects
from modalframe.plans.cohort import DETAIL_TABLES, build_features, label_report, require
from modalframe.sources.sinks import write_metrics, write_table
from modalframe.sources.tables import read_table, snapshot


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--tables", required=True, help="folder with one parquet table per source table")
    ap.add_argument("--out", required=True)
    ap.add_argument("--index_mode", choices=["row", "first_non_null"], default="row")
    args = ap.parse_args(argv)
    spark = get_spark("cohort")
    tables = {t: read_table(spark, f"{args.tables}/{t}") for t in ("patients", "admissions", *DETAIL_TABLES)}
    subjects = snapshot(eligible_subjects(tables["patients"], tables["admissions"]), f"{args.out}/selected_subject_ids")
    require(subjects, ["subject_id"], "selected subjects")
    write_table(build_features(tables, subjects, args.index_mode), f"{args.out}/patient_features")
    write_metrics(label_report(read_table(spark, f"{args.out}/patient_features")), f"{args.out}/label_distribution")


if __name__ == "__main__":
    main()
