"""Scalar numeric, time and hashing expressions."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_HASH_HEX_DIGITS = 13  # 52 bits: every value is an exact double


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def is_finite(c: Column | str) -> Column:
    """True for ordinary numbers, false for NaN and +-inf, NULL for NULL. Mentions its input once, so it stays small
    when the optimizer pushes it through projections."""
    return col_of(c).cast("double") * 0.0 == 0.0


def finite(c: Column | str) -> Column:
    """NaN and +-inf become NULL."""
    c = col_of(c).cast("double")
    return F.when(is_finite(c), c)


def nan_to_null(c: Column | str) -> Column:
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def clip(c: Column | str, low: float, high: float) -> Column:
    """NULL stays NULL (plain greatest/least would replace it by a bound)."""
    c = col_of(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def round_to(c: Column | str, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0."""
    return F.round(col_of(c), digits) + F.lit(0.0)


def sigmoid(x: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-col_of(x)))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (1.0 - q))


def days_between(start: Column | str, end: Column | str) -> Column:
    """Fractional days `end - start`, exact to the microsecond, independent of the session time zone."""
    seconds = (col_of(end) - col_of(start)).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / F.lit(86400.0)


def safe_double(c: Column | str) -> Column:
    """Anything that is not a number becomes 0.0."""
    return F.coalesce(nan_to_null(col_of(c).try_cast("double")), F.lit(0.0))


def normal_quantile(alpha: float) -> float:
    """Two-sided critical value for level `alpha`."""
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie strictly between 0 and 1, got {alpha}")
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def hash_key(ident: Column | str, seed: int | str) -> Column:
    """Deterministic shuffle key: md5 of `id:seed`, the same text in any engine."""
    return F.md5(F.concat(col_of(ident).cast("string"), F.lit(f":{seed}")).cast("binary"))


def _digits_to_unit(key: Column, start: int) -> Column:
    digits = F.substring(key, start, _HASH_HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**_HASH_HEX_DIGITS))


def hash_uniform(ident: Column | str, seed: int | str) -> Column:
    """Uniform in [0, 1) from the hash key."""
    return _digits_to_unit(hash_key(ident, seed), 1)


def hash_normal(ident: Column | str, seed: int | str) -> Column:
    """Standard normal by Box-Muller on the two halves of one hash key."""
    return bind(
        hash_key(ident, seed),
        lambda key: F.sqrt(-2.0 * F.log(1.0 - _digits_to_unit(key, 1)))
        * F.cos(_digits_to_unit(key, _HASH_HEX_DIGITS + 1) * F.lit(6.283185307179586)),
    )


def hash_slot(word: Column | str, slots: int) -> Column:
    """Slot 0..slots-1 of a text by the leading digits of its md5."""
    digits = F.substring(F.md5(col_of(word).cast("binary")), 1, _HASH_HEX_DIGITS)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")
