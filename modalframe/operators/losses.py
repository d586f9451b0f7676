"""Loss formulas as aggregates over logit tables, plus masked reconstruction and the contrastive score."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_key
from ..functions.vectors import as_double, squared_error
from .ordered import hash_bucket, row_numbers
from .training import TASK_WEIGHTS

# Fixed values: (alpha, gamma at start, gamma at end) and share of the focal term per task; smoothing; temperature
FOCAL = {"readmission": (0.25, 2.0, 5.0), "icu": (0.5, 1.5, 3.0), "mortality": (0.75, 2.5, 5.0)}
FOCAL_SHARE = {"readmission": 0.7, "icu": 0.7, "mortality": 0.9}
SMOOTHING = 0.1
TEMPERATURE = 0.1
BATCH_ROWS = 32
TILE_ROWS = 4_096
FULL_PARTS = 12  # parts of a batch from which on parts grow to TILE_ROWS rows before more are made
SLICE_ROWS = 512


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce(logit: Column | str, target: Column | str) -> Column:
    """Binary cross-entropy on a logit, stable for large values; `target` may be fractional."""
    x, y = _c(logit), _c(target)
    return (1.0 - y) * softplus(x) + y * softplus(-x)


def focal(logit: Column | str, target: Column | str, gamma: float, alpha: float | tuple[float, float] | None = None) -> Column:
    """Per-row focal loss; a scalar alpha scales both classes alike, a pair is (negative, positive)."""
    y = _c(target)
    ce = bce(logit, y)
    loss = F.pow(1.0 - F.exp(-ce), F.lit(gamma)) * ce
    if alpha is None:
        return loss
    return loss * (F.lit(alpha) if not isinstance(alpha, tuple) else alpha[1] * y + alpha[0] * (1.0 - y))


def focal_gamma(start: float, end: float, progress: float) -> float:
    return start + (end - start) * progress


def smoothed(target: Column | str, smoothing: float = SMOOTHING) -> Column:
    return _c(target) * (1.0 - smoothing) + 0.5 * smoothing


def _reduce(loss: Column, reduction: str) -> Column:
    if reduction not in ("mean", "sum"):
        raise ValueError("reduction must be 'mean' or 'sum'; use the column expression for per-row losses")
    return F.avg(loss) if reduction == "mean" else F.sum(loss)


def bce_loss(df: DataFrame, group: Sequence[str] = ("task",), logit: str = "logit", label: str = "label", weighted: Sequence[str] = ("mortality",)) -> DataFrame:
    """Mean BCE per group. For the tasks in `weighted`, positives weigh n / (2 n_pos), all from one aggregation; with no
    positives the weight is NULL and does not matter."""
    x, y = F.col(logit), F.col(label)
    stats = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("_p"), F.sum(y * softplus(-x)).alias("_pos"), F.sum((1.0 - y) * softplus(x)).alias("_neg")
    )
    weight = F.when(F.col("task").isin(*weighted), F.col("n") / F.nullif(2.0 * F.col("_p"), F.lit(0.0))).otherwise(F.lit(1.0)) if weighted else F.lit(1.0)
    return stats.select(*group, "n", weight.alias("pos_weight"), ((F.col("_neg") + F.coalesce(weight * F.col("_pos"), F.lit(0.0))) / F.col("n")).alias("loss"))


def focal_loss(df: DataFrame, progress: float, group: Sequence[str] = ("task",), logit: str = "logit", label: str = "label", reduction: str = "mean") -> DataFrame:
    """Focal loss per task with that task's alpha and scheduled gamma."""
    loss = F.lit(None).cast("double")
    for task, (alpha, start, end) in FOCAL.items():
        loss = F.when(F.col("task") == task, focal(logit, label, focal_gamma(start, end, progress), alpha)).otherwise(loss)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), _reduce(loss, reduction).alias("loss"))


def smoothing_loss(df: DataFrame, group: Sequence[str] = ("task",), logit: str = "logit", label: str = "label", smoothing: float = SMOOTHING) -> DataFrame:
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(bce(logit, smoothed(label, smoothing))).alias("loss"))


def compound_loss(df: DataFrame, progress: float, logit: str = "logit", label: str = "label", task_weights: dict[str, float] | None = None) -> DataFrame:
    """Focal and smoothed terms mixed per task, plus the task-weighted `total` row."""
    weights = task_weights or TASK_WEIGHTS
    per_task = (
        focal_loss(df, progress, logit=logit, label=label)
        .withColumnRenamed("loss", "focal")
        .join(smoothing_loss(df, logit=logit, label=label).select("task", F.col("loss").alias("smooth")), "task")
    )
    share = F.create_map(*[x for t, s in FOCAL_SHARE.items() for x in (F.lit(t), F.lit(s))])[F.col("task")]
    weight = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(w))])[F.col("task")]
    mixed = per_task.select("task", (share * F.col("focal") + (1.0 - share) * F.col("smooth")).alias("loss"))
    total = mixed.agg(F.sum(weight * F.col("loss")).alias("loss")).select(F.lit("total").alias("task"), "loss")
    return mixed.unionByName(total)


def reconstruction_mse(df: DataFrame, triples: dict[str, tuple[str, str, str]]) -> DataFrame:
    """`(modality, n, mse)` over rows whose flag is 1, for `triples[name] = (rebuilt, original, flag)`, plus the mean
    over modalities with at least one such row as `overall`."""
    items = []
    for name, (rebuilt, original, flag) in triples.items():
        on = F.col(flag) == 1
        sq = F.sum(F.when(on, squared_error(rebuilt, original)))
        size = F.sum(F.when(on, F.size(original)))
        items.append(F.struct(F.lit(name).alias("modality"), F.count_if(on).alias("n"), (sq / size).alias("mse")))
    per = df.agg(F.array(*items).alias("_i"))
    present = F.filter("_i", lambda s: s["n"] > 0)
    mean = F.aggregate(present, F.lit(0.0), lambda acc, s: acc + s["mse"]) / F.greatest(F.size(present), F.lit(1))
    overall = F.struct(F.lit("overall").alias("modality"), F.aggregate("_i", F.lit(0).cast("long"), lambda a, s: a + s["n"]).alias("n"), mean.alias("mse"))
    return per.select(F.explode(F.concat(F.col("_i"), F.array(overall))).alias("s")).select("s.*")


def assign_batches(df: DataFrame, ident: str, rows: int = BATCH_ROWS, seed: int = 42, out: str = "batch_id") -> DataFrame:
    """Batches of exactly `rows` rows (the last may be smaller) in md5(id:seed) order."""
    keyed = df.withColumn("_h", hash_key(ident, seed))
    numbered = row_numbers(keyed, [], ["_h", ident], hash_bucket("_h"), "_rn")
    return numbered.select(*df.columns, F.floor((F.col("_rn") - 1) / rows).cast("long").alias(out))


def _tiled(df: DataFrame, batch: str, ident: str, tile: int) -> DataFrame:
    """Every row once for each pair of parts (`_i`, `_j`) of its batch that it takes part in: as one of the scored rows (`_role` 0), of those
    compared with (1), or of both (2, the pairs of a part with itself). A batch of up to `tile` rows is one part. As a row is sent twice for each part, a batch is cut
    into no more than `FULL_PARTS` parts as long as they hold up to `TILE_ROWS` rows (or `tile`, if larger) each."""
    n = F.count(F.lit(1))
    parts = F.least(F.ceil(n / tile), F.greatest(F.lit(FULL_PARTS), F.ceil(n / max(tile, TILE_ROWS))))
    sizes = df.groupBy(F.col(batch).alias("_b")).agg(parts.cast("int").alias("_k"))
    rows = df.join(sizes, F.col(batch).eqNullSafe(F.col("_b"))).drop("_b").withColumn("_p", F.pmod(F.xxhash64(F.col(ident)), F.col("_k")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda q: q != F.col("_p"))

    def place(i: Column, j: Column, role: int) -> Column:
        return F.struct(i.alias("_i"), j.alias("_j"), F.lit(role).alias("_role"))

    p = F.col("_p")
    places = F.concat(F.array(place(p, p, 2)), F.transform(others, lambda q: place(p, q, 0)), F.transform(others, lambda q: place(q, p, 1)))
    return rows.withColumn("_at", F.explode(places)).select(*df.columns, "_at.*")


def _log_sum(parts: Column) -> Column:
    """log of the summed exponentials from `(top, total)` pairs, `total` being the sum relative to exp(top)."""
    top = F.array_max(F.transform(parts, lambda s: s["top"]))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, s: acc + F.when(s["total"] > 0, s["total"] * F.exp(s["top"] - top)).otherwise(0.0))
    return top + F.log(total)


def contrastive_score(
    df: DataFrame, ident: str, features: str, pattern: str, batch: str = "batch_id", temperature: float = TEMPERATURE, plain_sums: bool = False, tile: int = TILE_ROWS
) -> DataFrame:
    """InfoNCE per row that shares its pattern with another row of its batch: `(batch, ident, n_positive, loss)`.

    Batches may have any size: one of more than about `tile` rows is cut into parts, each pair of parts is a task group of its own, and for each row the maximum
    and the sum relative to it, of positives and of all, are merged over the parts. No pair is ever emitted and no group holds more than
    two parts. The result does not depend on `tile`. Rows without vector are left out; repeated ids are rows of their own; NULL patterns are alike.

    Default: positives over all other rows. `plain_sums=True` uses the looser sums in which every non-positive adds exp(0) to the numerator and the row itself
    is part of the denominator.
    """
    kind, kind_b = (df.schema[c].dataType.simpleString() for c in (ident, batch))
    slice_rows = SLICE_ROWS

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # by id and vector, so that a row has the same place in every pair of its part
        order = sorted(range(len(pdf)), key=lambda r: (pdf[ident].iat[r], tuple(pdf[features].iat[r])))
        pdf = pdf.iloc[order]
        x = np.array(pdf[features].tolist(), dtype=np.float64)
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(norm > 0, norm, 1.0)
        codes, role = pdf[pattern].to_numpy(dtype=object), pdf["_role"].to_numpy()
        left, right = np.flatnonzero(role != 1), np.flatnonzero(role != 0)

        def summed(sim: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sim = np.where(counted, sim, -np.inf)
            top = sim.max(axis=1, initial=-np.inf)
            return top, np.exp(sim - np.where(np.isfinite(top), top, 0.0)[:, None]).sum(axis=1)

        found = []
        for start in range(0, max(len(left), 1), slice_rows):
            mine = left[start : start + slice_rows]
            sim = x[mine] @ x[right].T / temperature
            other = mine[:, None] != right[None, :]
            same = (codes[mine][:, None] == codes[right][None, :]) & other
            if plain_sums:
                sums = *summed(np.where(same, sim, 0.0), np.ones_like(same)), *summed(sim, np.ones_like(same))
            else:
                sums = *summed(sim, same), *summed(sim, other)
            found.append(pd.DataFrame({"_place": np.arange(start, start + len(mine)), "n": same.sum(axis=1), **dict(zip(("pt", "ps", "bt", "bs"), sums))}))
        out = pd.concat(found, ignore_index=True)
        out.insert(0, "_own", key[1])
        out.insert(0, ident, pdf[ident].to_numpy()[left])
        out.insert(0, batch, key[0])
        return out

    slim = df.select(batch, ident, pattern, as_double(features).alias(features)).filter(F.col(features).isNotNull())
    partial = _tiled(slim, batch, ident, tile).groupBy(batch, "_i", "_j").applyInPandas(
        score, f"{batch} {kind_b}, {ident} {kind}, _own int, _place long, n long, pt double, ps double, bt double, bs double"
    )
    # one pair of sums for each part of the batch
    pairs = {k: F.collect_list(F.struct(F.col(f"{k}t").alias("top"), F.col(f"{k}s").alias("total"))).alias(k) for k in "pb"}
    merged = partial.groupBy(batch, ident, "_own", "_place").agg(F.sum("n").alias("n_positive"), *pairs.values()).filter("n_positive > 0")
    return merged.select(batch, ident, "n_positive", (_log_sum(F.col("b")) - _log_sum(F.col("p"))).alias("loss"))


__all__ = [
    "FOCAL", "bce", "focal", "bce_loss", "focal_loss", "smoothing_loss", "compound_loss", "reconstruction_mse", "assign_batches",
    "contrastive_score",
]
