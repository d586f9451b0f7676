"""Class weights, curriculum subsets, sample weights and weighted sampling.

Every weight depends on the (label, pattern) cell only: at most 2 x 16 cells. Counts are taken per cell, weights are
computed on the cell table, which joins back to the rows (Catalyst broadcasts it while it is small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import hash_key, hash_uniform
from ..functions.patterns import pattern_complexity
from .ordered import bucket_of_cuts, hash_bucket, row_numbers

# Curriculum stages (progress limit, share of patterns, tasks) and weight mix
STAGES = (
    ("easy", 0.3, 0.4, ("icu",)),
    ("medium", 0.7, 0.7, ("icu", "mortality")),
    ("hard", 1.0, 1.0, ("icu", "mortality", "readmission")),
)
MIN_SUBSET_SHARE = 0.1
MAX_CELLS = 10_000
LABEL_SHARE, PATTERN_SHARE = 0.8, 0.2


def _over_all(c: Column) -> Column:
    """Over the whole cell or pattern table, which has at most 32 rows."""
    return c.over(W.partitionBy())


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """`(label, n, weight)` for classes 0 and 1 with weight n_total / (2 n); NULL weight for an absent class."""
    y = F.col(label)
    counts = df.agg(F.count(F.lit(1)).alias("t"), F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
    items = [F.struct(F.lit(k).alias("label"), F.col(f"n{k}").alias("n")) for k in (0, 1)]
    return counts.select("t", F.explode(F.array(*items)).alias("s")).select(
        "s.label", "s.n", F.when(F.col("s.n") > 0, F.col("t") / (2.0 * F.col("s.n"))).alias("weight")
    )


def curriculum_stage(epoch: int, total_epochs: int) -> str:
    progress = epoch / total_epochs
    return next((name for name, limit, _, _ in STAGES if progress <= limit), STAGES[-1][0])


def active_tasks(epoch: int, total_epochs: int) -> tuple[str, ...]:
    stage = curriculum_stage(epoch, total_epochs)
    return next(tasks for name, _, _, tasks in STAGES if name == stage)


def pattern_plan(df: DataFrame, epoch: int, total_epochs: int, pattern: str = "pattern_code") -> DataFrame:
    """`(pattern, n, complexity, n_rows, allowed)`: the easiest patterns of the epoch's stage are allowed, at least
    one; ties by code."""
    stage = curriculum_stage(epoch, total_epochs)
    share = next(s for name, _, s, _ in STAGES if name == stage)
    # all windows here run over the at most 16 pattern rows
    table = df.groupBy(pattern).agg(F.count(F.lit(1)).alias("n")).withColumn("complexity", pattern_complexity(pattern))
    rank = F.row_number().over(W.partitionBy().orderBy("complexity", pattern))
    limit = F.greatest(F.lit(1), F.floor(_over_all(F.count(F.lit(1))) * F.lit(share)))
    return table.withColumn("n_rows", _over_all(F.sum("n"))).withColumn("allowed", rank <= limit)


def allowed_patterns(df: DataFrame, epoch: int, total_epochs: int, pattern: str = "pattern_code") -> DataFrame:
    return pattern_plan(df, epoch, total_epochs, pattern).filter("allowed").drop("allowed")


def curriculum_subset(df: DataFrame, epoch: int, total_epochs: int, pattern: str = "pattern_code") -> DataFrame:
    """Rows of the allowed patterns; all rows when that would keep less than 10 % of them."""
    plan = pattern_plan(df, epoch, total_epochs, pattern)
    kept = _over_all(F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)))
    plan = plan.withColumn("_keep", F.col("allowed") | (kept < F.col("n_rows") * MIN_SUBSET_SHARE))
    return df.join(plan.filter("_keep").select(pattern), pattern, "left_semi")


def cell_weights(cells: DataFrame, label: str, pattern: str) -> DataFrame:
    """Normalised weight of each (label, pattern) cell with `n` rows; weights of all rows sum to the row count."""
    total = _over_all(F.sum("n"))
    n_label, n_pattern = F.sum("n").over(W.partitionBy(label)), F.sum("n").over(W.partitionBy(pattern))
    k_label = F.size(_over_all(F.collect_set(label)))
    k_pattern = F.size(_over_all(F.collect_set(pattern)))
    by_label = F.when(k_label > 1, total / (k_label * n_label)).otherwise(F.lit(1.0))
    raw = LABEL_SHARE * by_label + PATTERN_SHARE * total / (k_pattern * n_pattern)
    weighed = cells.withColumn("_raw", raw).withColumn("_t", total)
    return weighed.withColumn("weight", F.col("_raw") / _over_all(F.sum(F.col("_raw") * F.col("n"))) * F.col("_t")).drop("_raw", "_t")


def _valid_cells(df: DataFrame, label: str, pattern: str, allowed: Sequence[int] | None) -> DataFrame:
    """Row counts of the cells of valid rows: those with a label and a pattern."""
    cells = df.filter(F.col(label).isNotNull() & F.col(pattern).isNotNull()).groupBy(label, pattern).agg(F.count(F.lit(1)).alias("n"))
    if allowed is None:
        return cells
    inside = F.col(pattern).isin(*allowed) if allowed else F.lit(False)
    any_inside = _over_all(F.max(inside.cast("int")))
    return cells.withColumn("_any", any_inside).filter(inside | (F.col("_any") == 0)).drop("_any")


def sample_weights(df: DataFrame, label: str, pattern: str = "pattern_code", allowed: Sequence[int] | None = None) -> DataFrame:
    """Add `weight`: 0.8 inverse label frequency + 0.2 inverse pattern frequency, normalised over valid rows; 0 for
    patterns not in `allowed` (an `allowed` list that matches nothing is ignored) and for rows without label or pattern."""
    cells = cell_weights(_valid_cells(df, label, pattern, allowed), label, pattern)
    joined = df.join(cells.drop("n"), [label, pattern], "left")
    return joined.select(*df.columns, F.coalesce("weight", F.lit(0.0)).alias("weight"))


def weighted_sample(
    df: DataFrame, label: str, pattern: str = "pattern_code", ident: str = "subject_id", allowed: Sequence[int] | None = None, seed: int = 42
) -> DataFrame:
    """Draw with replacement, as many draws as valid rows: `(draw_id, ident)`.

    Each valid row (one with label and pattern, in an allowed pattern) contributes one draw. One uniform picks the cell
    (cells partition [0,1) by total weight) by a binary search in a literal array, another the position in the cell; an
    equi-join on (cell, position) fetches the row. Positions follow md5(id:seed). At most `MAX_CELLS` cells.
    """
    cells = cell_weights(_valid_cells(df, label, pattern, allowed), label, pattern)
    order = W.partitionBy().orderBy(label, pattern).rowsBetween(W.unboundedPreceding, W.currentRow)
    mass = F.col("weight") * F.col("n")
    cells = cells.withColumn("_hi", F.sum(mass).over(order) / _over_all(F.sum(mass)))
    edge = F.lag("_hi", 1, 0.0).over(W.partitionBy().orderBy(label, pattern))
    last = F.lead("_hi").over(W.partitionBy().orderBy(label, pattern)).isNull()
    cells = cells.withColumn("_lo", edge).withColumn("_hi", F.when(last, F.lit(1.0)).otherwise(F.col("_hi")))
    rows = [r for r in cells.orderBy(label, pattern).limit(MAX_CELLS + 1).collect()]
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} (label, pattern) cells")
    if not rows:
        return df.select(F.col(ident).alias("draw_id"), F.col(ident)).limit(0)
    valid = df.select(ident, label, pattern).join(df.sparkSession.createDataFrame(rows, cells.schema).select(label, pattern), [label, pattern], "left_semi")
    pool = row_numbers(valid.withColumn("_h", hash_key(ident, seed)), [label, pattern], ["_h", ident], hash_bucket("_h"), "_pos")
    u1, u2 = hash_uniform(ident, f"{seed}:cell"), hash_uniform(ident, f"{seed}:row")
    draws = valid.select(F.col(ident).alias("draw_id"), u1.alias("_u1"), u2.alias("_u2"))
    uppers = F.array(*[F.lit(float(r["_hi"])) for r in rows])
    at = bucket_of_cuts(F.col("_u1"), uppers, len(rows))
    # upper ends that are at most the uniform: an even bucket lies between two, an odd one exactly on one
    number = F.least(F.shiftright(at + 1, 1), F.lit(len(rows) - 1))
    fields = cells.schema
    chosen = {c: F.get(F.array(*[F.lit(r[c]).cast(fields[c].dataType) for r in rows]), number) for c in (label, pattern, "n")}
    picked = draws.select("draw_id", "_u2", *[e.alias(c) for c, e in chosen.items()])
    picked = picked.select("draw_id", label, pattern, (F.floor(F.col("_u2") * F.col("n")) + 1).cast("long").alias("_pos"))
    return picked.join(pool.select(label, pattern, "_pos", ident), [label, pattern, "_pos"]).select("draw_id", ident)
