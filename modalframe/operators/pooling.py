"""Pooling many vectors per subject into one."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, l2_norm

_TINY = 1e-300  # keeps a group of zero vectors defined (its mean is zero) without moving any other result


def pool_vectors(df: DataFrame, ident: str, vector: str, strategy: str = "weighted_mean", out: str = "pooled") -> DataFrame:
    """One vector per `ident`: `weighted_mean` (weights = L2 norm), `max_pool`, anything else = plain mean.

    NULL vectors are skipped. The summarizer keeps one buffer per key and partition and merges buffers, so a subject
    with very many vectors never has to fit in one task, and rows are not multiplied by the dimension.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(ident, as_double(vector).alias("_v"))
    vec = array_to_vector("_v")
    if strategy == "weighted_mean":
        agg = Summarizer.mean(vec, F.greatest(l2_norm("_v"), F.lit(_TINY)))
    elif strategy == "max_pool":
        agg = Summarizer.max(vec)
    else:
        agg = Summarizer.mean(vec)
    return rows.groupBy(ident).agg(agg.alias("_p"), F.count(F.lit(1)).alias("n_vectors")).select(
        ident, vector_to_array("_p").alias(out), "n_vectors"
    )


def embedding_coverage(df: DataFrame, text: str = "discharge_embedding", rad: str = "radiology_embedding") -> DataFrame:
    """One row: subjects, subjects with each vector, with both, and the shares in percent."""
    has_text, has_rad = F.col(text).isNotNull(), F.col(rad).isNotNull()

    def total(c):
        return F.sum(c.cast("long"))

    n = F.count(F.lit(1))
    rows = F.nullif(n, F.lit(0))  # shares of an empty table are NULL
    return df.agg(
        n.alias("n"),
        total(has_text).alias("n_text"),
        total(has_rad).alias("n_rad"),
        total(has_text & has_rad).alias("n_both"),
        (total(has_text) * 100.0 / rows).alias("pct_text"),
        (total(has_rad) * 100.0 / rows).alias("pct_rad"),
    )
