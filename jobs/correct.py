"""spark-submit jobs/correct.py --csv_path PATH [--selective] [--output_prefix P]: correct saved predictions by pattern."""

from __future__ import annotations

import argparse

from _common import get_spark

from modalframe.operators.correction import correct_predictions
from modalframe.operators.metrics import pr_points, roc_points, stack_scores
from modalframe.sources.sinks import write_csv, write_metrics, write_table
from modalframe.sources.tables import read_prediction_file


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--csv_path", required=True, help="saved predictions, CSV or parquet")
    ap.add_argument("--selective", action="store_true", help="only keep corrections that improve the ranking")
    ap.add_argument("--output_prefix", default="correction_results")
    ap.add_argument("--ignore_labels", action="store_true", help="leave out the nudges that read the evaluation labels")
    ap.add_argument("--resume", help="folder for the steps of the run; a run that finds steps there goes on after the last one")
    args = ap.parse_args(argv)
    spark = get_spark("correct")
    source = read_prediction_file(spark, args.csv_path)
    done = correct_predictions(source.rows, args.selective, not args.ignore_labels, folder=args.resume)
    base = f"{args.output_prefix}{'_selective' if args.selective else ''}"
    columns = ["subject_id", "readm_target", "readm_pred_original", "readm_pred_corrected", "icu_target", "icu_pred_original", "icu_pred_corrected", "status"]
    write_csv(done.rows.select(*columns), f"{base}_results")
    write_metrics(done.metrics(), f"{base}_metrics")
    write_table(source.rejected, f"{base}_rejected")
    write_metrics(spark.createDataFrame([(k, int(n)) for k, n in source.counts.items()], "kind string, n long"), f"{base}_input")
    history = spark.createDataFrame([(h["iteration"], h["readm_auc"], h["icu_auc"]) for h in done.history], "iteration int, readm_auc double, icu_auc double")
    write_metrics(history, f"{base}_history")
    run = [(done.reference, done.best_iteration, len(done.history), done.used_labels)]
    write_metrics(spark.createDataFrame(run, "reference string, best_iteration int, total_iterations int, used_labels boolean"), f"{base}_run")
    sides = {side: (f"readm_pred_{side}", "readm_target") for side in ("original", "corrected")}
    write_table(roc_points(stack_scores(done.rows, sides), ["task"], thin=True), f"{base}_roc")
    write_table(pr_points(stack_scores(done.rows, sides), ["task"]), f"{base}_pr")


if __name__ == "__main__":
    main()
