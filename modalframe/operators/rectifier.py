"""Per-group mean-bias estimates ("rectifiers"), their shrinkage rules, confidence intervals and application.

The parameter table has one row per (task, modality): `delta, var_delta, n, n_initial`. Groups are missing-modality
patterns, so the table is small where patterns are the groups, and Catalyst
broadcasts it then; other keys may be many, so there is no hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, finite, is_finite, normal_quantile

# The estimator's guards
MIN_FIT_ROWS = 10
MIN_VARIANCE = 1e-4
SINGLE_ROW_VARIANCE = 0.1
MAX_DELTA = 0.3
SMALL_SAMPLE = 30
DEFAULT_KEYS = ("task", "modality")
RANK_STRENGTH = 0.7
DEFAULT_ALPHA = 0.05


def gold_rows(df: DataFrame, pred: str, label: str) -> DataFrame:
    """Input hygiene: drop non-finite rows, clip predictions to [0,1], round labels (half to even) into {0,1}."""
    kept = df.withColumn(pred, F.col(pred).cast("double")).withColumn(label, F.col(label).cast("double"))
    kept = kept.filter(is_finite(pred) & is_finite(label))
    p, y = F.col(pred), F.bround(F.col(label), 0)
    return kept.withColumns(
        {pred: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)), label: F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))}
    )


def _moments(weight: str | None) -> list[Column]:
    e = F.col("_e")
    cols = [F.count(F.lit(1)).alias("n"), F.avg(e).alias("_mean"), F.var_samp(e).alias("_var")]
    if weight:
        w = F.coalesce(finite(weight), F.lit(0.0))
        cols += [
            F.sum(w).alias("_sw"), F.sum(w * w).alias("_sww"), F.sum(w * e).alias("_swe"), F.sum(w * e * e).alias("_swee"),
        ]
    return cols


def fit(
    df: DataFrame,
    pred: str,
    label: str,
    keys: Sequence[str] = DEFAULT_KEYS,
    weight: str | None = None,
    previous: DataFrame | None = None,
) -> DataFrame:
    """Parameter table for all groups at once. `previous` keeps the first `n_initial` seen for a key across refits."""
    rows = gold_rows(df, pred, label).withColumn("_e", F.col(pred) - F.col(label))
    stats = rows.groupBy(*keys).agg(*_moments(weight))
    mean, var, size = F.col("_mean"), F.col("_var"), F.col("n").cast("double")
    if weight:
        usable = F.col("_sw") != 0
        wmean = F.col("_swe") / F.nullif(F.col("_sw"), F.lit(0.0))
        n_eff = F.col("_sw") * F.col("_sw") / F.nullif(F.col("_sww"), F.lit(0.0))
        spread = F.col("_swee") / F.nullif(F.col("_sw"), F.lit(0.0)) - wmean * wmean
        wvar = F.when(n_eff > 1, spread * n_eff / F.nullif(n_eff - 1.0, F.lit(0.0))).otherwise(F.lit(SINGLE_ROW_VARIANCE))
        mean, var = F.when(usable, wmean).otherwise(mean), F.when(usable, wvar).otherwise(var)
        size = F.when(usable, F.floor(n_eff).cast("double")).otherwise(size)
    stats = stats.select(*keys, "n", mean.alias("_mean"), F.greatest(var, F.lit(MIN_VARIANCE)).alias("_var"), size.alias("_size"))
    d = F.when(F.abs("_mean") > MAX_DELTA, F.signum("_mean") * MAX_DELTA).otherwise(F.col("_mean"))
    d = F.when(F.col("_size") < SMALL_SAMPLE, d * F.greatest(F.lit(0.3), F.col("_size") / float(SMALL_SAMPLE))).otherwise(d)
    stats = stats.withColumn("_d", d)
    ratio = F.abs("_d") / F.sqrt("_var")
    shaky = (F.col("_var") > 0.2) & (F.abs("_d") > 0.01) & (ratio < 0.5)
    d = F.when(shaky, F.col("_d") * F.least(F.lit(0.8), F.greatest(F.lit(0.2), ratio))).otherwise(F.col("_d"))
    enough = F.col("n") >= MIN_FIT_ROWS
    table = stats.select(
        *keys,
        F.when(enough, F.coalesce(finite(d), F.lit(0.0))).otherwise(F.lit(0.0)).alias("delta"),
        F.when(enough, F.col("_var")).otherwise(F.lit(0.0)).alias("var_delta"),
        "n",
        F.when(enough, F.col("n")).alias("n_initial"),
    )
    if previous is None:
        return table
    first = previous.select(*keys, F.col("n_initial").alias("_first"))
    merged = table.join(first, list(keys), "left")
    return merged.select(*keys, "delta", "var_delta", "n", F.coalesce("_first", "n_initial").alias("n_initial"))


def adjusted_delta(
    delta: Column, n: Column, n_initial: Column, theta: Column, spread: Column, epoch: int | None = None
) -> list[tuple[str, Column]]:
    """The adaptive rules as ordered column definitions; the last one, `delta_adj`, is the result."""
    a = F.col("_adj")

    def cap(share: float) -> Column:
        too_big = F.abs(a / F.greatest(F.lit(0.01), theta)) > share
        return F.when(too_big, share * theta * F.signum(a)).otherwise(a)

    steps: list[Column] = [
        delta * 1.2,
        F.when(spread > 0.25, a * F.greatest(F.lit(0.3), 0.7 - (spread - 0.25))).otherwise(a),
        cap(0.15),
        F.when(n < n_initial * 0.7, delta * F.greatest(F.lit(0.3), n / n_initial)).otherwise(a),
    ]
    if epoch is not None:
        steps.append(a * F.lit(min(1.0, (epoch - 10) / 20.0) if epoch > 10 else 0.1))
    steps += [
        F.when(spread > 0.3, a * F.greatest(F.lit(0.4), 0.8 - (spread - 0.3))).otherwise(a),
        cap(0.2),
        F.when(theta - a < 0, theta - 0.01).when(theta - a > 1, theta - 0.99).otherwise(a),
    ]
    return [("_adj", s) for s in steps] + [("delta_adj", a)]


def transform(
    df: DataFrame, params: DataFrame, pred: str, keys: Sequence[str] = DEFAULT_KEYS, epoch: int | None = None
) -> DataFrame:
    """Per group: `theta_rect, theta_tilde, var_f, delta_adj, var_delta, n_unlabeled, status`.

    Groups without a fitted row get NULLs and status 'unfitted'; groups with no finite prediction get zeros.
    """
    value = finite(pred)
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("theta_tilde"), F.var_samp(value).alias("_v"), F.count(value).alias("n_unlabeled")
    )
    # one row per group: both sides of this join are tables of pattern size
    joined = stats.join(params, list(keys), "left").withColumn(
        "var_f", F.when(F.col("n_unlabeled") > 1, F.col("_v")).otherwise(F.lit(SINGLE_ROW_VARIANCE))
    )
    joined = joined.withColumn("_s", F.sqrt("var_f"))
    steps = adjusted_delta(
        F.col("delta"), F.col("n").cast("double"), F.col("n_initial").cast("double"), F.col("theta_tilde"), F.col("_s"), epoch
    )
    for name, expr in steps:
        joined = joined.withColumn(name, expr)
    empty, unfitted = F.col("n_unlabeled") == 0, F.col("delta").isNull()
    zero = F.lit(0.0)
    status = F.when(empty, "empty").when(unfitted, "unfitted").otherwise("ok")

    def out(c: Column) -> Column:
        return F.when(empty, zero).otherwise(c)

    return joined.select(
        *keys,
        out(F.col("theta_tilde") - F.col("delta_adj")).alias("theta_rect"),
        out(F.col("theta_tilde")).alias("theta_tilde"),
        out(F.col("var_f")).alias("var_f"),
        out(F.col("delta_adj")).alias("delta_adj"),
        out(F.col("var_delta")).alias("var_delta"),
        "n_unlabeled",
        status.alias("status"),
    )


def confidence_interval(
    df: DataFrame,
    theta: str = "theta_tilde",
    var_f: str = "var_f",
    delta: str = "delta_adj",
    var_delta: str = "var_delta",
    n_gold: str = "n",
    n_unlabeled: str = "n_unlabeled",
    alpha: float = DEFAULT_ALPHA,
) -> DataFrame:
    """Add `ci_low, ci_center, ci_high`; NULL when a sample has at most one row or a variance is negative."""
    z = normal_quantile(alpha)
    valid = (F.col(n_gold) > 1) & (F.col(n_unlabeled) > 1) & (F.col(var_delta) >= 0) & (F.col(var_f) >= 0)
    se = F.sqrt(F.col(var_delta) / F.col(n_gold) + F.col(var_f) / F.col(n_unlabeled))
    center = F.col(theta) - F.col(delta)
    return df.select(
        "*",
        F.when(valid, center - z * se).alias("ci_low"),
        F.when(valid, center).alias("ci_center"),
        F.when(valid, center + z * se).alias("ci_high"),
    )


def subtract_delta(
    df: DataFrame, params: DataFrame, pred: str, flag: str, keys: Sequence[str] = DEFAULT_KEYS, out: str = "corrected"
) -> DataFrame:
    """`pred - delta` where the modality flag is 0, unchanged elsewhere; no clipping. Unknown keys stay unchanged."""
    slim = params.select(*keys, F.col("delta").alias("_delta"))  # groups x 1 row
    moved = F.when(F.col(flag) == 0, F.col(pred) - F.coalesce(F.col("_delta"), F.lit(0.0))).otherwise(F.col(pred))
    return df.join(slim, list(keys), "left").withColumn(out, moved).drop("_delta")


def rank_aware(pred: Column, delta: Column, missing: Column, edge_adjust: bool = False) -> Column:
    """Rank-aware correction of one score: shift by 0.7 delta, push scores near 0.5 away, pull the rest of 0.4-0.6 in.

    NULL delta leaves the score unchanged and unclipped. `edge_adjust` also nudges scores outside 0.4-0.6 outwards.
    """
    q = pred - RANK_STRENGTH * delta
    side = F.signum(q - 0.5)
    middle = F.when(F.abs(q - 0.5) < 0.05, q + 0.07 * side).otherwise(q - 0.05 * side)
    edge = q + F.when((q < 0.2) | (q > 0.8), 0.01 * side).otherwise(0.03 * side) if edge_adjust else q
    moved = F.when((q >= 0.4) & (q <= 0.6), middle).otherwise(edge)
    return F.when(delta.isNull(), pred).otherwise(clip(F.when(missing, moved).otherwise(pred), 0.0, 1.0))


def apply_rank_aware(
    df: DataFrame,
    params: DataFrame,
    pred: str,
    flag: str,
    keys: Sequence[str] = DEFAULT_KEYS,
    out: str = "corrected",
    edge_adjust: bool = False,
) -> DataFrame:
    slim = params.select(*keys, F.col("delta").alias("_delta"))
    joined = df.join(slim, list(keys), "left")
    value = rank_aware(F.col(pred), F.col("_delta"), F.col(flag) == 0, edge_adjust)
    return joined.withColumn(out, value).drop("_delta")


def all_corrections(params: DataFrame) -> DataFrame:
    """Listing of every stored rectifier: `key, delta, var_delta, n_samples`."""
    return params.select(
        F.concat_ws("_", "task", "modality").alias("key"), "delta", "var_delta", F.col("n").alias("n_samples")
    )
