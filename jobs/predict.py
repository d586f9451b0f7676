"""spark-submit jobs/predict.py --features DIR --text DIR --images DIR --out DIR: split, scale, train, score, report."""

from __future__ import annotations

import argparse

from _common import get_spark

from modalframe.operators import metrics, modality, split
from modalframe.operators.models import TASK_LABELS
from modalframe.plans.predict import prepare_dataset, train_and_predict
from modalframe.sources.sinks import write_metrics, write_table
from modalframe.sources.tables import read_table


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--features", required=True)
    ap.add_argument("--text", required=True)
    ap.add_argument("--images", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--scaler", choices=["robust", "minmax", "power", "standard"], default="robust")
    ap.add_argument("--seed", type=int, default=split.DEFAULT_SEED)
    args = ap.parse_args(argv)
    spark = get_spark("predict")
    wide = read_table(spark, args.features)
    flags = modality.availability_flags(wide.select("subject_id"), read_table(spark, args.images), read_table(spark, args.text))
    write_table(prepare_dataset(wide, flags, args.scaler, args.seed), f"{args.out}/dataset")
    dataset = read_table(spark, f"{args.out}/dataset")
    y = TASK_LABELS
    write_metrics(split.split_balance(dataset, y["mortality"], y["readmission"], y["icu"], "pattern_code"), f"{args.out}/split_balance")
    write_metrics(modality.dataset_statistics(dataset), f"{args.out}/dataset_statistics")
    write_table(metrics.prediction_analysis(train_and_predict(dataset).drop("modality_count", "missing_pattern")), f"{args.out}/predictions")
    predictions = read_table(spark, f"{args.out}/predictions")
    write_metrics(metrics.ranking_metrics(metrics.stack_tasks(predictions), ["task"]), f"{args.out}/test_metrics")
    write_table(metrics.roc_points(metrics.stack_tasks(predictions), ["task"], thin=True), f"{args.out}/roc_points")
    write_table(metrics.pr_points(metrics.stack_tasks(predictions), ["task"]), f"{args.out}/pr_points")


if __name__ == "__main__":
    main()
