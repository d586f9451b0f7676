"""Wide exchange layout for several vectors per subject: `subject_id, file_0 ... file_k`, text cells, '' = none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vector_text


def to_wide(df: DataFrame, ident: str, vector: str, order: list[str], width: int | None = None) -> DataFrame:
    """Pad every subject to the largest vector count, or to `width` if that is larger: no vector is left out.

    The column count equals that maximum and a subject's vectors meet in one row, as the layout wants it; it suits data with
    few vectors per subject, and the long table stays the native form.
    """
    most = df.groupBy(ident).count().agg(F.max("count")).first()[0] or 0
    width = max(most, width or 0)
    keyed = F.struct(*order, F.col(vector).alias("_v"))
    listed = df.groupBy(ident).agg(F.array_sort(F.collect_list(keyed)).alias("_l"))
    cell = [F.coalesce(vector_text(F.get("_l", F.lit(i))["_v"]), F.lit("")).alias(f"file_{i}") for i in range(width)]
    return listed.select(ident, *cell)


def from_wide(wide: DataFrame, ident: str, out: str = "embedding") -> DataFrame:
    """Back to one row per vector `(ident, pos, vector)`; empty cells and subjects without any vector vanish."""
    files = sorted((c for c in wide.columns if c.startswith("file_")), key=lambda c: int(c[5:]))
    cells = wide.select(ident, F.posexplode(F.array(*files)).alias("pos", "_t")).filter(F.length(F.trim("_t")) > 0)
    return cells.select(ident, "pos", F.from_json("_t", "array<double>").alias(out))
