"""Column statistics, mean imputation, winsorising and the data-quality report.

Statistics are fitted in one aggregation over all columns and reach the driver as one row; applying them is a
projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite
from ..functions.patterns import FLAGS
from .features import is_numeric
from .labels import LABELS

# Never features / known only after the outcome / bookkeeping
NON_FEATURES = ("subject_id", *LABELS)
LEAKING = ("idx_discharge_location", "idx_severity_mode")
BOOKKEEPING = (*FLAGS, "pattern_code", "missing_pattern", "split")
OUTLIER_DEVIATIONS = 3.0


class ColumnStats(NamedTuple):
    mean: float | None
    std: float | None
    n_missing: int


def feature_columns(df: DataFrame, exclude: Sequence[str] = (*NON_FEATURES, *BOOKKEEPING)) -> list[str]:
    """Every column that is not excluded, in table order."""
    return [c for c in df.columns if c not in exclude]


def numeric_features(df: DataFrame, exclude: Sequence[str] = (*NON_FEATURES, *BOOKKEEPING)) -> list[str]:
    return [f.name for f in df.schema.fields if f.name not in exclude and is_numeric(f.dataType)]


def drop_leaking(df: DataFrame, columns: Sequence[str] = LEAKING) -> DataFrame:
    return df.drop(*columns)


def column_stats(df: DataFrame, cols: Sequence[str], where: Column | None = None) -> dict[str, ColumnStats]:
    """Mean, sample deviation and missing count of each column, in one pass."""
    rows = df if where is None else df.filter(where)
    exprs = []
    for i, c in enumerate(cols):
        v = finite(f"`{c}`")
        exprs += [F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}"), F.count_if(v.isNull()).alias(f"n{i}")]
    r = rows.agg(*exprs).first()
    return {c: ColumnStats(r[f"m{i}"], r[f"s{i}"], r[f"n{i}"]) for i, c in enumerate(cols)}


def impute_mean(df: DataFrame, cols: Sequence[str] | None = None, stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """Numeric NULL/NaN -> column mean (0 when the column has no value), string NULL -> ''."""
    cols = list(cols) if cols is not None else numeric_features(df)
    stats = stats or column_stats(df, cols)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in cols:
            out.append(F.coalesce(finite(c), F.lit(float(stats[f.name].mean or 0.0))).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and f.name not in NON_FEATURES:
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def _bounds(s: ColumnStats) -> tuple[float, float] | None:
    if s.mean is None or not s.std:
        return None
    return s.mean - OUTLIER_DEVIATIONS * s.std, s.mean + OUTLIER_DEVIATIONS * s.std


def winsorize(df: DataFrame, cols: Sequence[str] | None = None, stats: dict[str, ColumnStats] | None = None) -> DataFrame:
    """Cap numeric features at mean +- 3 sample deviations; constant columns are left alone.

    Flags and pattern codes are not features here. Pass them in `cols` to cap them as well.
    """
    cols = list(cols) if cols is not None else numeric_features(df)
    stats = stats or column_stats(df, cols)
    capped = {}
    for c in cols:
        bounds = _bounds(stats[c])
        if bounds:
            v = finite(f"`{c}`")
            capped[c] = F.when(v < bounds[0], bounds[0]).when(v > bounds[1], bounds[1]).otherwise(v)
    return df.withColumns(capped) if capped else df


def quality_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """`(column, n_missing, n_high, n_low)`: gaps as loaded, outliers counted after mean imputation."""
    cols = list(cols) if cols is not None else numeric_features(df)
    raw = column_stats(df, cols)
    filled = impute_mean(df.select(*[f"`{c}`" for c in cols]), cols, raw)
    stats = column_stats(filled, cols)
    items = []
    for c in cols:
        bounds = _bounds(stats[c])
        v = F.col(f"`{c}`")
        high = F.count_if(v > bounds[1]) if bounds else F.lit(0).cast("long")
        low = F.count_if(v < bounds[0]) if bounds else F.lit(0).cast("long")
        items.append(
            F.struct(F.lit(c).alias("column"), F.lit(raw[c].n_missing).cast("long").alias("n_missing"), high.alias("n_high"), low.alias("n_low"))
        )
    return filled.agg(F.array(*items).alias("_i")).select(F.explode("_i").alias("s")).select("s.*")
