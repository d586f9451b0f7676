"""Ranking and calibration metrics over prediction tables.

All ranking metrics come from one relation, `score_curve`: one row per distinct score with the positives and
negatives at it and below it. Scores are pre-aggregated before any shuffle and no group sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import is_finite
from ..functions.patterns import FLAGS, modality_count, pattern_string
from .ordered import DEFAULT_BUCKETS, bucket_of, running_totals, value_splits

# Task -> (prediction column, target column, prefix of derived columns)
TASKS = {
    "readmission": ("readmission_prediction", "readmission_target", "readm"),
    "icu": ("icu_prediction", "icu_target", "icu"),
    "mortality": ("mortality_prediction", "mortality_target", "mortality"),
}
DECISION_THRESHOLD = 0.5


def stack_scores(df: DataFrame, pairs: dict[str, tuple[Column | str, Column | str]], keep: Sequence[str] = ()) -> DataFrame:
    """Long form `(task, score, label, *keep)`, one row per input row and entry of `pairs[task] = (score, label)`.

    One pass over the input: an array of the entries is exploded, and what follows counts scores map-side.
    """

    def as_col(c):
        return F.col(c) if isinstance(c, str) else c

    entries = [
        F.struct(F.lit(task).alias("task"), as_col(s).cast("double").alias("score"), as_col(y).cast("double").alias("label"))
        for task, (s, y) in pairs.items()
    ]
    return df.select(*keep, F.explode(F.array(*entries)).alias("_e")).select(*keep, "_e.task", "_e.score", "_e.label")


def stack_tasks(df: DataFrame, keep: Sequence[str] = (), tasks: Sequence[str] = tuple(TASKS)) -> DataFrame:
    return stack_scores(df, {t: TASKS[t][:2] for t in tasks}, keep)


def _score_counts(df: DataFrame, group: Sequence[str], score: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Usable rows, and positives/negatives per (group, score)."""
    rows = df.select(*group, F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("_y"))
    rows = rows.filter(is_finite("score") & is_finite("_y"))
    counts = rows.groupBy(*group, "score").agg(
        F.sum((F.col("_y") == 1).cast("long")).alias("pos"), F.sum((F.col("_y") != 1).cast("long")).alias("neg")
    )
    return rows, counts


def auc_and_brier(
    df: DataFrame,
    group: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    splits: Sequence[float] | None = None,
    n_buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """`n`, `n_pos`, `auc`, `brier` per group without joining anything back.

    The area is additive over value buckets: pairs inside a bucket plus its positives times the negatives in lower
    buckets. So one window inside buckets and one over the bucket totals are enough.
    """
    rows, counts = _score_counts(df, group, score, label)
    cuts = value_splits(rows, "score", n_buckets) if splits is None else splits
    return auc_of_counts(counts, group, cuts)


def auc_with_overall(df: DataFrame, part: str, task: str, splits: Sequence[float], score: str = "score", label: str = "label", whole: str = "*") -> DataFrame:
    """As `auc_and_brier` by (part, task), and for each task over all parts (`part` = `whole`), from one counting of the scores."""
    _, counts = _score_counts(df, [part, task], score, label)
    both = counts.unionByName(counts.withColumn(part, F.lit(whole)))
    merged = both.groupBy(part, task, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return auc_of_counts(merged, [part, task], splits)


def auc_of_counts(counts: DataFrame, group: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """`auc_and_brier` of rows already counted as (group, score, pos, neg)."""
    pos, neg, s = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("score")
    inside = W.partitionBy(*group, "_bucket").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    local = counts.withColumn("_bucket", bucket_of("score", cuts)).withColumn(
        "_below", F.coalesce(F.sum("neg").over(inside), F.lit(0)).cast("double")
    )
    per_bucket = local.groupBy(*group, "_bucket").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(pos * (F.col("_below") + neg / 2.0)).alias("_w"),
        F.sum(pos * F.pow(s - 1.0, 2) + neg * F.pow(s, 2)).alias("_q"),
    )
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("double")
    per_group = per_bucket.withColumn("_lower", lower).groupBy(*group).agg(
        F.sum("_p").alias("_p"), F.sum("_n").alias("_n"), F.sum("_q").alias("_q"),
        F.sum(F.col("_w") + F.col("_p").cast("double") * F.col("_lower")).alias("_w"),
    )
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    return per_group.select(
        *group,
        (F.col("_p") + F.col("_n")).alias("n"),
        F.col("_p").alias("n_pos"),
        F.when((p > 0) & (n > 0), F.col("_w") / (p * n)).alias("auc"),
        (F.col("_q") / (p + n)).alias("brier"),
    )


def score_curve(
    df: DataFrame,
    group: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    splits: Sequence[float] | None = None,
    n_buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Per (group, score): `pos`, `neg`, `pos_below`, `neg_below`, `pos_total`, `neg_total`.

    Rows whose score or label is NULL or not finite are left out. `splits` can be passed when several calls see
    about the same score distribution; they affect balance only.
    """
    rows, counts = _score_counts(df, group, score, label)
    if splits is None:
        splits = value_splits(rows, "score", n_buckets)
    return running_totals(counts, group, ["score"], {"pos": "pos", "neg": "neg"}, bucket_of("score", splits))


def ranking_metrics(
    df: DataFrame,
    group: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    splits: Sequence[float] | None = None,
    n_buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """Per group: `n`, `n_pos`, `auc` (ties count half), `ap` (step form), `brier`. One-class groups give NULL auc."""
    curve = score_curve(df, group, score, label, splits, n_buckets)
    tp, fp = F.col("pos_total") - F.col("pos_below"), F.col("neg_total") - F.col("neg_below")
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = F.sum(pos * (F.col("neg_below") + neg / 2.0))
    area = F.sum(pos * tp / (tp + fp))
    sq = F.sum(pos * F.pow(F.col("score") - 1.0, 2) + neg * F.pow(F.col("score"), 2))
    per_group = curve.groupBy(*group).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), wins.alias("_w"), area.alias("_a"), sq.alias("_q")
    )
    p, n = F.col("_p").cast("double"), F.col("_n").cast("double")
    return per_group.select(
        *group,
        (F.col("_p") + F.col("_n")).alias("n"),
        F.col("_p").alias("n_pos"),
        F.when((p > 0) & (n > 0), F.col("_w") / (p * n)).alias("auc"),
        F.when(p > 0, F.col("_a") / p).alias("ap"),
        (F.col("_q") / (p + n)).alias("brier"),
    )


def roc_points(
    df: DataFrame, group: Sequence[str] = (), thin: bool = False, splits: Sequence[float] | None = None, **kw
) -> DataFrame:
    """ROC table `(group, fpr, tpr, threshold)` incl. the start point (0,0) with a NULL threshold.

    `thin` drops points in the middle of a straight run of equal steps; the curve stays the same.
    """
    if splits is None:
        splits = value_splits(df, kw.get("score", "score"))
    curve = score_curve(df, group, splits=splits, **kw)
    p, n = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    curve = curve.filter((p > 0) & (n > 0))
    tp, fp = p - F.col("pos_below"), n - F.col("neg_below")
    top = (tp == F.col("pos")) & (fp == F.col("neg"))
    start = curve.filter(top).select(
        *group, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    if thin:
        step = F.struct("pos", "neg")
        lower = F.lag(step).over(W.partitionBy(*group, "_bucket").orderBy("score"))
        curve = curve.withColumn("_bucket", bucket_of("score", splits)).withColumn("_same", lower == step)
        curve = curve.filter(top | ~F.coalesce(F.col("_same"), F.lit(False)))
    points = curve.select(*group, (fp / n).alias("fpr"), (tp / p).alias("tpr"), F.col("score").alias("threshold"))
    return points.unionByName(start)


def pr_points(df: DataFrame, group: Sequence[str] = (), **kw) -> DataFrame:
    """PR table `(group, recall, precision, threshold, prevalence)` incl. the end point (0,1) with a NULL threshold."""
    curve = score_curve(df, group, **kw)
    p, n = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    curve = curve.filter(p > 0)
    tp, fp = p - F.col("pos_below"), n - F.col("neg_below")
    prevalence = (p / (p + n)).alias("prevalence")
    points = curve.select(
        *group, (tp / p).alias("recall"), (tp / (tp + fp)).alias("precision"), F.col("score").alias("threshold"), prevalence
    )
    end = curve.filter((F.col("pos_below") == 0) & (F.col("neg_below") == 0)).select(
        *group, F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(None).cast("double").alias("threshold"), prevalence
    )
    return points.unionByName(end)


def prediction_analysis(df: DataFrame) -> DataFrame:
    """Prediction table plus modality count, pattern, and per task absolute error, correctness and confidence."""
    cols = [modality_count().alias("modality_count"), pattern_string().alias("missing_pattern")]
    for pred, target, short in TASKS.values():
        p, y = F.col(pred), F.col(target)
        cols += [
            F.abs(p - y).alias(f"{short}_abs_error"),
            ((p >= DECISION_THRESHOLD) == (y == 1)).cast("int").alias(f"{short}_correct"),
            (F.abs(p - DECISION_THRESHOLD) * 2.0).alias(f"{short}_confidence"),
        ]
    return df.select("*", *cols)


def accuracy_by_modality_count(df: DataFrame) -> DataFrame:
    """Accuracy per task for each modality count and overall (`modality_count` NULL), in one pass."""
    rows = prediction_analysis(df)
    return rows.rollup("modality_count").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"{short}_correct").alias(f"{short}_accuracy") for _, _, short in TASKS.values()]
    )


def compare_metrics(
    df: DataFrame, before: dict[str, tuple[str, str]], after: dict[str, tuple[str, str]], **kw
) -> DataFrame:
    """Metrics of the same tasks before and after a change, with deltas: `(task, metric, before, after, delta)`."""
    pairs = {f"{t}|before": v for t, v in before.items()} | {f"{t}|after": v for t, v in after.items()}
    m = ranking_metrics(stack_scores(df, pairs), ["task"], **kw)
    long = m.select(
        F.split("task", r"\|")[0].alias("task"),
        F.split("task", r"\|")[1].alias("side"),
        F.explode(F.create_map(*[x for k in ("auc", "ap", "brier") for x in (F.lit(k), F.col(k))])).alias("metric", "value"),
    )
    return (
        long.groupBy("task", "metric")
        .agg(
            F.max(F.when(F.col("side") == "before", F.col("value"))).alias("before"),
            F.max(F.when(F.col("side") == "after", F.col("value"))).alias("after"),
        )
        .withColumn("delta", F.col("after") - F.col("before"))
    )


__all__ = [
    "TASKS", "FLAGS", "stack_scores", "stack_tasks", "auc_and_brier", "score_curve", "ranking_metrics", "roc_points", "pr_points",
    "prediction_analysis", "accuracy_by_modality_count", "compare_metrics",
]
