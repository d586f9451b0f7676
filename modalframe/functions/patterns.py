"""Availability flags, missing-pattern codes and their complexity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODALITIES = ("struct", "img", "text", "rad")
FLAGS = tuple(f"has_{m}" for m in MODALITIES)
COMPLETE = 15


def _flags(flags):
    return [F.col(f) if isinstance(f, str) else f for f in flags]


def pattern_code(flags=FLAGS) -> Column:
    """8*struct + 4*img + 2*text + rad."""
    cols = _flags(flags)
    code = F.lit(0)
    for c in cols:
        code = F.shiftleft(code, 1) + c.cast("int")
    return code


def pattern_string(flags=FLAGS) -> Column:
    """Four characters in the order struct, img, text, rad."""
    return F.concat(*[c.cast("int").cast("string") for c in _flags(flags)])


def decode_pattern(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.lpad(F.bin(code.cast("long")), 4, "0")


def code_of_pattern(pattern: Column | str) -> Column:
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    return F.conv(pattern, 2, 10).cast("int")


def modality_count(flags=FLAGS) -> Column:
    total = F.lit(0)
    for c in _flags(flags):
        total = total + c.cast("int")
    return total


def pattern_complexity(code: Column | str) -> Column:
    """Absent modalities, eased when structured (-0.5) or else image (-0.3) data is there; complete rows are 0."""
    code = F.col(code) if isinstance(code, str) else code
    absent = (F.lit(4) - F.bit_count(code)).cast("double")
    eased = (
        F.when(code == COMPLETE, F.lit(0.0))
        .when(code.bitwiseAND(8) != 0, absent - 0.5)
        .when(code.bitwiseAND(4) != 0, absent - 0.3)
        .otherwise(absent)
    )
    return F.greatest(eased, F.lit(0.0))
