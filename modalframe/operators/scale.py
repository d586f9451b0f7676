"""Scalers fitted on training rows only; a zero means "missing" and is neither fitted nor scaled."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite, safe_double
from ..session import materialize
from .clean import LEAKING, feature_columns, numeric_features
from .quantiles import exact_quantiles, stack_columns

METHODS = ("robust", "minmax", "power", "standard")
_NEAR_ZERO = 10 * 2.220446049250313e-16
LAMBDA_TOLERANCE = 1e-8
PLAIN_EXPONENT = 30.0  # up to here powers keep enough digits as they are
MAX_SCANS = 60


class Scaler(NamedTuple):
    """`power` is the lambda of a power transform. With a `shift`, center and scale refer to the transform times exp(-shift) and, for a column of the one
    sign `sign`, less its value at the end of the range: the same scaled values where plain powers would overflow or lose their digits."""

    center: float
    scale: float
    power: float | None = None
    shift: float = 0.0
    sign: int = 0


def _safe(scale: float) -> float:
    return 1.0 if scale is None or scale < _NEAR_ZERO else scale


def _fit_moments(df: DataFrame, cols: Sequence[str], method: str) -> dict[str, Scaler]:
    exprs = []
    for i, c in enumerate(cols):
        v = finite(f"`{c}`")
        v = F.when(v != 0, v)
        pair = (F.min(v), F.max(v)) if method == "minmax" else (F.avg(v), F.stddev_pop(v))
        exprs += [pair[0].alias(f"a{i}"), pair[1].alias(f"b{i}")]
    r = df.agg(*exprs).first()
    out = {}
    for i, c in enumerate(cols):
        a, b = r[f"a{i}"], r[f"b{i}"]
        if a is not None:
            out[c] = Scaler(a, _safe(b - a)) if method == "minmax" else Scaler(a, _safe(b))
    return out


def yeo_johnson(x: Column, lam: Column | float) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    down = F.when(F.abs(lam - 2.0) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, up).otherwise(down)


_SERIES_BELOW = 0.05


def _power_terms(t: Column, a: Column, m: Column) -> tuple[Column, Column, Column]:
    """`exp(-m) * (exp(a*t) - 1) / a` and its first and second derivative by `a`, for any `a`, zero included."""
    z = a * t
    far = F.exp(z - m)
    other = F.nullif(a, F.lit(0.0))
    value = (far - F.exp(-m)) / other
    first = (t * far - value) / other
    second = (t * t * far - 2.0 * first) / other

    def series(weights: list[float]) -> Column:
        total = F.lit(weights[-1])
        for w in reversed(weights[:-1]):
            total = total * z + F.lit(w)
        return total * F.exp(-m)

    k = range(9)
    near = F.abs(z) < _SERIES_BELOW
    return (
        F.when(near, t * series([1.0 / math.factorial(i + 1) for i in k])).otherwise(value),
        F.when(near, t * t * series([(i + 1.0) / math.factorial(i + 2) for i in k])).otherwise(first),
        F.when(near, t * t * t * series([(i + 1.0) * (i + 2.0) / math.factorial(i + 3) for i in k])).otherwise(second),
    )


class _Range(NamedTuple):
    """What stays the same over all scans of a column: values, sum of signed logs, and the ranges of log1p|x| on both sides."""

    n: float
    slope: float
    up: tuple[float, float] | None
    down: tuple[float, float] | None

    @property
    def sign(self) -> int:
        return 0 if self.up and self.down else 1 if self.up else -1

    def at(self, lam: float) -> tuple[float, float]:
        """(reference value, shift) that keep every exponent at or below zero: of a column of one sign the end of the range with the largest power, else zero."""
        if self.sign:
            low, high = self.up or self.down
            a = lam if self.sign > 0 else 2.0 - lam
            ref = high if a > 0 else low
            return ref, a * ref
        return 0.0, max(lam * self.up[1], (2.0 - lam) * self.down[1], 0.0)


def _power_sums(long: DataFrame, ranges: dict[str, _Range], lams: dict[str, float]) -> dict[str, dict[str, float]]:
    """Mean, variance and the covariances with the derivatives, of every column at its lambda, in one scan."""
    spark = long.sparkSession
    rows = [(c, lam, ranges[c].at(lam)[0], 0.0 if ranges[c].sign else ranges[c].at(lam)[1]) for c, lam in lams.items()]
    table = spark.createDataFrame(rows, "column string, lam double, ref double, m double")  # one row per column
    up = F.col("value") > 0
    a = F.when(up, F.col("lam")).otherwise(2.0 - F.col("lam"))
    terms = long.join(F.broadcast(table), "column").select(
        "column", F.col("_n").cast("double").alias("w"), F.signum("value").alias("s"), (F.log1p(F.abs("value")) - F.col("ref")).alias("t"), a.alias("a"), "m"
    )
    f, f1, f2 = _power_terms(F.col("t"), F.col("a"), F.col("m"))
    terms = terms.select("column", "w", (F.col("s") * f).alias("y"), f1.alias("d"), (F.col("s") * f2).alias("e"))
    y, d, e, w = (F.col(c) for c in "ydew")
    mean = terms.groupBy("column").agg(*[(F.sum(w * v) / F.sum(w)).alias(k) for k, v in {"y": y, "d": d, "e": e, "yy": y * y, "yd": y * d, "dd": d * d, "ye": y * e}.items()])
    return {r["column"]: r.asDict() for r in mean.collect()}


def _fit_power(df: DataFrame, cols: Sequence[str]) -> dict[str, Scaler]:
    """Maximum-likelihood lambda per column, without a limit: Newton steps on the derivative of the profile likelihood for all columns at once, a scan each.

    Equal values are counted once for all scans. A step that leaves the bracket of the sign change, or that the curvature does not support, is replaced by
    halving the bracket, or while there is none by a doubled step outwards. A column with a single value gets lambda 1.
    """
    long = stack_columns(df, cols, skip_zero=True).groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n"))
    long = materialize(long, "values")
    u, w = F.log1p(F.abs("value")), F.col("_n").cast("double")
    up, down = F.col("value") > 0, F.col("value") < 0
    ends = [fn(F.when(side, u)).alias(f"{k}{fn.__name__}") for k, side in (("u", up), ("d", down)) for fn in (F.min, F.max)]
    ranges, single, out = {}, {}, {}
    facts = long.groupBy("column").agg(F.sum(w).alias("n"), F.sum(F.signum("value") * u * w).alias("slope"), F.count(F.lit(1)).alias("distinct"), F.min("value").alias("one"), *ends)
    for r in facts.collect():
        if r["distinct"] == 1:
            single[r["column"]] = Scaler(r["one"], 1.0, 1.0)
            continue
        pair = {k: (r[f"{k}min"], r[f"{k}max"]) if r[f"{k}min"] is not None else None for k in "ud"}
        ranges[r["column"]] = _Range(r["n"], r["slope"], pair["u"], pair["d"])
    lams = dict.fromkeys(ranges, 1.0)
    low: dict[str, float] = {}
    high: dict[str, float] = {}
    for scan in range(MAX_SCANS):
        if not lams:
            break
        nexts = {}
        for c, m in _power_sums(long, ranges, lams).items():
            lam, rg = lams[c], ranges[c]
            var = m["yy"] - m["y"] ** 2
            move = (m["yd"] - m["y"] * m["d"]) / var  # half the derivative of log var
            ref = rg.at(lam)[0]
            rise = rg.slope / rg.n - move - rg.sign * ref
            bend = -(m["dd"] - m["d"] ** 2 + m["ye"] - m["y"] * m["e"]) / var + 2.0 * move**2
            if rise > 0:
                low[c] = lam
            else:
                high[c] = lam
            step = -rise / bend if bend < 0 else math.copysign(math.inf, rise)
            if c in low and c in high:
                wanted = lam + step if low[c] < lam + step < high[c] else 0.5 * (low[c] + high[c])
            else:
                reach = 2.0 * abs(lam - 1.0) + 1.0
                wanted = lam + max(-reach, min(reach, step))
            if abs(wanted - lam) <= LAMBDA_TOLERANCE * max(1.0, abs(lam)) or not math.isfinite(rise):
                out[c] = _power_scaler(lam, rg, m["y"], math.sqrt(max(var, 0.0)))
            else:
                nexts[c] = wanted
        lams = nexts
    if lams:
        raise ArithmeticError(f"no likelihood peak found in {MAX_SCANS} scans for {sorted(lams)}")
    return single | out


def _power_scaler(lam: float, rg: _Range, mean: float, std: float) -> Scaler:
    """Center and scale of the plain transform where its powers are moderate, else of the shifted one."""
    ref, m = rg.at(lam)
    reach = max(abs(power * side[1]) for power, side in ((lam, rg.up), (2.0 - lam, rg.down)) if side)
    if reach > PLAIN_EXPONENT:
        return Scaler(mean, std if 0.0 < std < math.inf else 1.0, lam, m, rg.sign)
    a = lam if rg.sign >= 0 else 2.0 - lam
    offset = rg.sign * (math.expm1(m) / a if abs(a) > 1e-12 else ref) if rg.sign else 0.0
    return Scaler(math.exp(m) * mean + offset, _safe(math.exp(m) * std), lam)


def power_transform(x: Column, s: Scaler) -> Column:
    """The transform that the center and scale of `s` refer to. A sign that the fit has not seen may reach the end of the range of doubles."""
    if not s.shift:
        return yeo_johnson(x, s.power)
    up, down = s.power, 2.0 - s.power
    u, v = F.log1p(x), F.log1p(-x)

    def side(w: Column, a: float, unit: float) -> Column:
        return (F.exp(a * w - s.shift) - unit) / a if abs(a) > 1e-12 else w * math.exp(-s.shift)

    if s.sign == 0:
        unit = math.exp(-s.shift)
        return F.when(x >= 0, side(u, up, unit)).otherwise(-side(v, down, unit))
    positive = s.sign > 0
    a = up if positive else down
    seen = side(u, up, 1.0) if positive else -side(v, down, 1.0)
    shrink = math.exp(min(-s.shift, 700.0))
    beyond = yeo_johnson(x, s.power) * shrink - s.sign * (1.0 - shrink) / a
    far = F.lit(1e300)
    return F.when((x >= 0) if positive else (x < 0), seen).otherwise(F.greatest(F.least(beyond, far), -far))


def fit_scaler(df: DataFrame, cols: Sequence[str] | None = None, method: str = "robust", train: Column | None = None) -> dict[str, Scaler]:
    """Center and scale per numeric column from the `train` rows. Columns without non-zero values get no scaler."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, got {method!r}")
    cols = list(cols) if cols is not None else [c for c in numeric_features(df) if c not in LEAKING]
    rows = (df if train is None else df.filter(train)).select(*[f"`{c}`" for c in cols])
    if method == "robust":
        quartiles = exact_quantiles(rows, cols, (0.25, 0.5, 0.75), skip_zero=True)
        return {c: Scaler(q[1], _safe(q[2] - q[0])) for c, q in quartiles.items()}
    if method == "power":
        return _fit_power(rows, cols)
    return _fit_moments(rows, cols, method)


def scaled(column: str, scaler: Scaler | None) -> Column:
    v = safe_double(f"`{column}`")
    if scaler is None:
        return v
    moved = v if scaler.power is None else power_transform(v, scaler)
    return F.when(v != 0, (moved - scaler.center) / scaler.scale).otherwise(F.lit(0.0))


def apply_scaler(df: DataFrame, scalers: dict[str, Scaler]) -> DataFrame:
    return df.withColumns({c: scaled(c, s) for c, s in scalers.items()})


def struct_vector(df: DataFrame, scalers: dict[str, Scaler] | None = None, out: str = "x_struct") -> DataFrame:
    """All features as one array in table order, leaking columns left out; text features count as 0."""
    cols = [c for c in feature_columns(df) if c not in LEAKING and c != out]
    return df.withColumn(out, F.array(*[scaled(c, (scalers or {}).get(c)) for c in cols]))
