"""spark-submit jobs/extract.py --source DIR --out DIR [--csv]: cohort ids, then every table restricted to them, stored.

Writes `{out}/selected_subject_ids`, `{out}/{table}` for each table with a subject column, `{out}/{dictionary}` whole, and
`{out}/_skipped` for sources that are missing or cannot be read. With `--csv` sources are `{table}.csv` with typed schemas;
lines that do not parse go to `{out}/_rejected/{table}`.
"""

from __future__ import annotations

import argparse

from _common import get_spark

from modalframe.plans.extract import DICTIONARIES, TABLES, extract
from modalframe.sources.sinks import write_metrics, write_table


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--source", required=True, help="folder with one parquet folder (or csv file) per table")
    ap.add_argument("--out", required=True)
    ap.add_argument("--csv", action="store_true", help="read csv instead of parquet")
    ap.add_argument("--tables", nargs="*", default=list(TABLES))
    ap.add_argument("--dictionaries", nargs="*", default=list(DICTIONARIES))
    args = ap.parse_args(argv)
    spark = get_spark("extract")
    done = extract(spark, args.source, args.tables, args.dictionaries, csv=args.csv)
    write_table(done.subjects, f"{args.out}/selected_subject_ids")
    for name, rows in done.tables.items():
        write_table(rows, f"{args.out}/{name}")
    for name, lines in done.rejected.items():
        write_table(lines, f"{args.out}/_rejected/{name}")
    write_metrics(spark.createDataFrame(sorted(done.skipped.items()), "source string, reason string"), f"{args.out}/_skipped")


if __name__ == "__main__":
    main()
