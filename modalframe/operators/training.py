"""Relational parts of training: adaptive task weights, model selection over an epoch log, noise replicas.

Windows here run per training run (or run and task): an epoch log has one row per epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import bind, hash_normal, sigmoid
from ..functions.vectors import as_double

# Base weight and bounds per task, thresholds, selection score and patience
TASK_WEIGHTS = {"readmission": 1.2, "icu": 1.0, "mortality": 1.5}
WEIGHT_BOUNDS = {"readmission": (0.5, 2.0), "icu": (0.5, 1.5), "mortality": (1.0, 3.0)}
LOW_METRIC, HIGH_METRIC = 0.75, 0.85
HISTORY = 3
WARMUP_EPOCHS = 5
SELECTION_SCORE = {"readmission": 0.45, "mortality": 0.35, "icu": 0.20}
PATIENCE = 15
REPLICAS, NOISE = 5, 0.01


def _by_task(values: dict[str, float], task: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*pairs)[task]


def adaptive_weights(log: DataFrame, metric: str = "auc") -> DataFrame:
    """Task weight in force at each (run, epoch, task): base weight, moved by the mean of the 3 latest earlier values."""
    earlier = W.partitionBy("run", "task").orderBy("epoch").rowsBetween(-HISTORY, -1)
    recent, seen = F.avg(metric).over(earlier), F.count(metric).over(earlier)
    rows = log.withColumn("recent", F.when(seen == HISTORY, recent))
    base = _by_task(TASK_WEIGHTS, F.col("task"))
    low = _by_task({k: b[0] for k, b in WEIGHT_BOUNDS.items()}, F.col("task"))
    high = _by_task({k: b[1] for k, b in WEIGHT_BOUNDS.items()}, F.col("task"))
    r = F.col("recent")
    moved = (
        F.when(r < LOW_METRIC, F.least(high, base * (1.5 - r)))
        .when(r > HIGH_METRIC, F.greatest(low, base * (0.8 + 0.2 * r)))
        .otherwise(base)
    )
    active = (F.col("epoch") > WARMUP_EPOCHS) & r.isNotNull()
    return rows.withColumn("weight", F.when(active, moved).otherwise(base))


def selection_scores(log: DataFrame, metric: str = "auc") -> DataFrame:
    """Per (run, epoch): combined score, whether it beats every earlier one (first must beat 0), epochs since then."""
    value = {t: F.max(F.when(F.col("task") == t, F.col(metric))) for t in SELECTION_SCORE}
    score = sum((w * value[t] for t, w in list(SELECTION_SCORE.items())[1:]), SELECTION_SCORE["readmission"] * value["readmission"])
    per_epoch = log.groupBy("run", "epoch").agg(score.alias("score"))
    order = W.partitionBy("run").orderBy("epoch")
    before = F.max("score").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = per_epoch.withColumn("improved", F.col("score") > F.greatest(F.coalesce(before, F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_i", F.row_number().over(order))
    last = F.max(F.when(F.col("improved"), F.col("_i"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("no_improvement", F.col("_i") - F.coalesce(last, F.lit(0))).drop("_i")


def best_epoch(log: DataFrame, metric: str = "auc", patience: int = PATIENCE) -> DataFrame:
    """Per run: best epoch and score up to the early stop, the stopping epoch (NULL if none), epochs run."""
    rows = selection_scores(log, metric)
    stop = F.min(F.when(F.col("no_improvement") >= patience, F.col("epoch"))).over(W.partitionBy("run"))
    rows = rows.withColumn("stop_epoch", stop).filter(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    return rows.groupBy("run").agg(
        F.max(F.when(F.col("improved"), F.col("epoch"))).alias("best_epoch"),
        F.max(F.when(F.col("improved"), F.col("score"))).alias("best_score"),
        F.max("stop_epoch").alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"),
    )


def noisy(vector: Column | str, ident: Column | str, replica: Column, sigma: float = NOISE, seed: int = 42) -> Column:
    """`vector` plus seeded N(0, sigma) noise per element; replica 0 is the clean vector."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    key = F.concat_ws(":", ident.cast("string"), replica.cast("string"))

    def moved(x: Column, i: Column) -> Column:
        z = hash_normal(F.concat_ws(":", key, i.cast("string")), seed)
        return F.when(replica == 0, x).otherwise(x + sigma * z)

    return F.transform(as_double(vector), moved)


def augmented_probability(
    vector: str, ident: str, scorer: Callable[[Column], Column], n: int = REPLICAS, sigma: float = NOISE, seed: int = 42
) -> tuple[Column, Column]:
    """(mean logit, probability) over 1 clean and n-1 noisy replicas for a `scorer` made of column expressions.

    Replicas live inside the row, so averaging needs no shuffle.
    """
    logits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: bind(noisy(vector, ident, r, sigma, seed), scorer))
    mean = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + x) / F.lit(float(n))
    return mean, sigmoid(mean)


def replicate(df: DataFrame, vector: str, ident: str, n: int = REPLICAS, sigma: float = NOISE, seed: int = 42) -> DataFrame:
    """One row per replica, for scorers that are not column expressions; average with `average_replicas`."""
    rows = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn(vector, noisy(vector, ident, F.col("replica"), sigma, seed))


def average_replicas(scored: DataFrame, ident: str, logit: str = "logit") -> DataFrame:
    """Mean logit per id, then the probability."""
    mean = scored.groupBy(ident).agg(F.avg(logit).alias("mean_logit"))
    return mean.withColumn("probability", sigmoid("mean_logit"))
