"""Array-of-float expressions: parsing, normalising, masking, fusing. Arithmetic is in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import bind

_BLANKS = " \t\n\r\f\x0b"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def nan_to_zero(v: Column | str) -> Column:
    """NULL and NaN elements become 0; a NULL vector stays NULL."""
    return F.transform(as_double(v), lambda x: F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)))


def fit_dim(v: Column | str, dim: int) -> Column:
    """Cut or zero-pad to `dim` elements."""
    v = as_double(v)
    return F.slice(F.concat(v, zeros(dim)), 1, dim)


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column | str) -> Column:
    """Unit length; the zero vector stays as it is."""
    v = as_double(v)
    packed = F.struct(v.alias("v"), l2_norm(v).alias("n"))
    return bind(packed, lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"])).otherwise(p["v"]))


def parse_vector(text: Column | str, dim: int) -> Column:
    """Lenient JSON array -> unit vector of `dim` doubles; anything unreadable becomes zeros."""
    t = F.btrim(_col(text), F.lit(_BLANKS))
    bracketed = F.when(t.startswith("[") & t.endswith("]"), t).otherwise(
        F.concat(F.lit("["), F.btrim(t, F.lit("[]")), F.lit("]"))
    )
    parsed = F.when(F.length(t) > 0, F.from_json(bracketed, "array<float>"))
    return F.coalesce(l2_normalize(fit_dim(nan_to_zero(parsed), dim)), zeros(dim))


def vector_text(v: Column | str, digits: int = 6) -> Column:
    """`[0.123456,...]`, the exchange format for CSV cells."""
    return F.concat(
        F.lit("["), F.array_join(F.transform(as_double(v), lambda x: F.format_string(f"%.{digits}f", x)), ","), F.lit("]")
    )


def vector_json(v: Column | str) -> Column:
    return F.to_json(_col(v))


def round_vector(v: Column | str, digits: int = 6) -> Column:
    return F.transform(as_double(v), lambda x: F.round(x, digits) + F.lit(0.0))


def masked_mean(tokens: Column | str, mask: Column | str) -> Column:
    """Mean over the token vectors whose mask is 1: `tokens` is array<array<double>>, `mask` array of 0/1."""
    tokens, mask = _col(tokens), as_double(mask)
    kept = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    start = F.transform(tokens[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, start, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    weight = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, x: acc + x), F.lit(1e-9))
    return F.transform(total, lambda x: x / weight)


def scale(v: Column | str, factor: Column | str) -> Column:
    factor = _col(factor).cast("double")
    return F.transform(as_double(v), lambda x: x * factor)


def fuse(vectors: Sequence[Column | str], flags: Sequence[Column | str]) -> Column:
    """Availability-weighted mean of same-length modality vectors; absent ones do not count."""
    weights = [_col(f).cast("double") for f in flags]
    n = sum(weights[1:], weights[0]) + F.lit(1e-8)
    total = None
    for v, w in zip(vectors, weights):
        part = scale(v, w)
        total = part if total is None else F.zip_with(total, part, lambda a, b: a + b)
    return F.transform(total, lambda x: x / n)


def mask_and_concat(vectors: Sequence[Column | str], flags: Sequence[Column | str]) -> Column:
    """Modality vectors zeroed where absent, concatenated, followed by the flags themselves."""
    parts = [scale(v, f) for v, f in zip(vectors, flags)]
    return F.concat(*parts, F.array(*[_col(f).cast("double") for f in flags]))


def cosine(a: Column | str, b: Column | str, temperature: float = 1.0) -> Column:
    return dot(l2_normalize(a), l2_normalize(b)) / F.lit(temperature)


def is_zero(v: Column | str) -> Column:
    return ~F.exists(as_double(v), lambda x: x != 0)


def squared_error(a: Column | str, b: Column | str) -> Column:
    """Sum of squared element differences."""
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x
    )
