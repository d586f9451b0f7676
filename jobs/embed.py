"""spark-submit jobs/embed.py --subjects DIR --notes DIR --records DIR --out DIR: text and image vectors per subject."""

from __future__ import annotations

import argparse

from _common import get_spark

from modalframe.operators.embedding import DEFAULT_DIM
from modalframe.operators.pooling import embedding_coverage
from modalframe.plans.embed import image_table, text_table
from modalframe.sources.records import readable, scan_records
from modalframe.sources.sinks import write_metrics, write_table
from modalframe.sources.tables import read_or_empty, read_table


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--subjects", required=True)
    ap.add_argument("--notes", required=True, help="parquet with subject_id, note_type, text; may be absent")
    ap.add_argument("--records", help="root of the record-file tree")
    ap.add_argument("--out", required=True)
    ap.add_argument("--dim", type=int, default=DEFAULT_DIM)
    ap.add_argument("--pooling", choices=["mean", "max_pool", "weighted_mean"], default="mean")
    args = ap.parse_args(argv)
    spark = get_spark("embed")
    subjects = read_table(spark, args.subjects).select("subject_id")
    schema = spark.createDataFrame([], "subject_id long, note_type string, text string").schema
    notes = read_or_empty(spark, args.notes, schema)
    write_table(text_table(notes, subjects, dim=args.dim), f"{args.out}/text_embeddings")
    write_metrics(embedding_coverage(read_table(spark, f"{args.out}/text_embeddings")), f"{args.out}/embedding_coverage")
    if args.records:
        write_table(scan_records(spark, args.records, subjects), f"{args.out}/image_records")
        records = read_table(spark, f"{args.out}/image_records")
        write_table(readable(records), f"{args.out}/image_vectors")
        # files that could not be read, with the reason: what is missing below is on record here
        write_table(records.filter("error IS NOT NULL").drop("embedding"), f"{args.out}/image_errors")
        write_table(image_table(read_table(spark, f"{args.out}/image_vectors"), subjects, args.pooling), f"{args.out}/image_embeddings")


if __name__ == "__main__":
    main()
