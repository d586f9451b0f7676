"""Exact quantiles of many columns, and distribution matching by rank."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, finite
from .ordered import bucket_of_cuts, ordered_bucket, row_numbers, rows_at_ranks

SPLITS_PER_COLUMN = 64
RANK_STEEPNESS = 6.0
MIN_REFERENCE_ROWS = 10


def stack_columns(df: DataFrame, cols: Sequence[str], skip_zero: bool = False) -> DataFrame:
    """`(column, value)` for every finite (and, if asked, non-zero) value of the numeric `cols`."""
    items = [F.struct(F.lit(c).alias("column"), finite(f"`{c}`").alias("value")) for c in cols]
    long = df.select(F.explode(F.array(*items)).alias("s")).select("s.column", "s.value").filter(F.col("value").isNotNull())
    return long.filter(F.col("value") != 0) if skip_zero else long


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], skip_zero: bool = False
) -> dict[str, list[float]]:
    """Linear-interpolated quantiles per column, exact for any row count.

    Equal values are counted first, then only the value buckets that hold a wanted rank are sorted. The driver sees
    columns x probs numbers. Columns without values are absent from the result.
    """
    spark = df.sparkSession
    counts = stack_columns(df, cols, skip_zero).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    shares = [i / SPLITS_PER_COLUMN for i in range(1, SPLITS_PER_COLUMN)]
    balance = counts.groupBy("column").agg(F.percentile_approx("value", shares, 20 * SPLITS_PER_COLUMN).alias("q"))
    cuts = {r["column"]: sorted(set(r["q"])) for r in balance.collect()}
    if not cuts:
        return {}
    # one row per column
    cut_table = spark.createDataFrame(list(cuts.items()), "column string, cuts array<double>")
    placed = counts.join(F.broadcast(cut_table), "column")
    ranks: dict[str, Column] = {}
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(float(p))
        ranks[f"{i}lo"], ranks[f"{i}hi"] = F.floor(pos) + 1, F.ceil(pos) + 1
    found = rows_at_ranks(
        placed, ["column"], ["value"], bucket_of_cuts(F.col("value"), F.col("cuts"), SPLITS_PER_COLUMN), ranks, "c"
    ).collect()
    at = {(r["column"], r["tag"]): (r["value"], r["n"]) for r in found}
    out: dict[str, list[float]] = {}
    for c in cuts:
        out[c] = []
        for i, p in enumerate(probs):
            (lo, n), (hi, _) = at[(c, f"{i}lo")], at[(c, f"{i}hi")]
            pos = (n - 1) * float(p)
            out[c].append(lo + (hi - lo) * (pos - math.floor(pos)))
    return out


def scaled_rank(df: DataFrame, score: str, ident: str, out: str = "rank01") -> DataFrame:
    """Ordinal rank of `score` (ties by `ident`) scaled to [0,1]; NULL when there is a single row."""
    ranked = row_numbers(df, [], [score, ident], ordered_bucket(df, [score, ident]), "_rn")
    n = F.col("_rn_total")
    return ranked.withColumn(out, F.when(n > 1, (F.col("_rn") - 1) / (n - 1))).drop("_rn", "_rn_total")


def rank_sigmoid(df: DataFrame, score: str, ident: str, out: str = "normalized", steepness: float = RANK_STEEPNESS) -> DataFrame:
    """Sigmoid of the centred rank; a single row keeps its score."""
    ranked = scaled_rank(df, score, ident, "_r")
    value = 1.0 / (1.0 + F.exp(-steepness * (F.col("_r") - 0.5)))
    return ranked.withColumn(out, F.coalesce(value, F.col(score))).drop("_r")


def quantile_match(
    df: DataFrame, reference: DataFrame, score: str, ident: str, ref_score: str, ref_ident: str, out: str = "normalized"
) -> DataFrame:
    """Give each row the reference value at its own rank (linear between neighbours), clipped to [0,1].

    With at most 10 reference rows the sigmoid of the rank is used instead.
    """
    if reference.limit(MIN_REFERENCE_ROWS + 1).count() <= MIN_REFERENCE_ROWS:
        return rank_sigmoid(df, score, ident, out)
    ref = reference.select(F.col(ref_score).alias("_v"), F.col(ref_ident).alias("_i"))
    ref = row_numbers(ref, [], ["_v", "_i"], ordered_bucket(ref, ["_v", "_i"]), "_rn")
    # neighbours side by side, so that one equi-join on the lower position is enough
    upper = ref.select((F.col("_rn") - 2).alias("_lo"), F.col("_v").alias("_hi_v"))
    knots = ref.select((F.col("_rn") - 1).alias("_lo"), F.col("_v").alias("_lo_v")).join(upper, "_lo", "left")
    m = reference.count()
    ranked = scaled_rank(df, score, ident, "_r")
    pos = F.col("_r") * F.lit(float(m - 1))
    ranked = ranked.withColumn("_pos", pos).withColumn("_lo", F.floor("_pos").cast("long"))
    joined = ranked.join(knots, "_lo", "left")
    value = F.col("_lo_v") + (F.coalesce("_hi_v", "_lo_v") - F.col("_lo_v")) * (F.col("_pos") - F.col("_lo"))
    return joined.select(*df.columns, F.coalesce(clip(value, 0.0, 1.0), F.col(score)).alias(out))
