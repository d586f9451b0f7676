"""Joins of a large, possibly skewed relation with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SALTS = 1
_SALT = "_salt"


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: str, how: str = "inner", salts: int = DEFAULT_SALTS
) -> DataFrame:
    """`big JOIN small` (`inner`, `left` or `left_semi`) with the rows of each key spread over `salts` tasks.

    Adaptive execution splits hot keys of these joins by itself, so by default nothing is salted and the partitioning by key
    stays. Ask for salts where it is off: `small` must then be narrow, as it is replicated `salts` times.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"unsupported join type {how!r}")
    if salts <= 1:
        return big.join(small, list(on), how)
    salted_big = big.withColumn(_SALT, F.pmod(F.hash(spread_by), F.lit(salts)))
    salted_small = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, [*on, _SALT], how).drop(_SALT)
