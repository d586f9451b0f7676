"""Modality availability, missing-pattern statistics and vector lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.patterns import FLAGS, decode_pattern, pattern_code, pattern_string
from ..functions.vectors import as_double, zeros
from .labels import LABELS


def _present(df: DataFrame, column: str) -> Column:
    """Non-NULL, and not blank when it is text."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        return c.isNotNull() & (F.length(F.trim(c)) > 0)
    return c.isNotNull()


def availability_flags(
    subjects: DataFrame,
    images: DataFrame,
    texts: DataFrame,
    text_col: str = "discharge_embedding",
    rad_col: str = "radiology_embedding",
    duplicates: str = "any",
) -> DataFrame:
    """`has_struct/img/text/rad`, `pattern_code` and `missing_pattern` per subject.

    Structured data is always there; an image counts when the id occurs, even with a NULL vector. When an id occurs
    twice in `texts`, `duplicates='any'` lets any usable row count; `'none'` gives 0 for such ids.
    """
    if duplicates not in ("any", "none"):
        raise ValueError(f"duplicates must be 'any' or 'none', got {duplicates!r}")
    img = images.select("subject_id").distinct().withColumn("has_img", F.lit(1))
    txt = texts.groupBy("subject_id").agg(
        F.max(_present(texts, text_col).cast("int")).alias("has_text"),
        F.max(_present(texts, rad_col).cast("int")).alias("has_rad"),
        F.count(F.lit(1)).alias("_n"),
    )
    if duplicates == "none":
        txt = txt.select("subject_id", *[F.when(F.col("_n") == 1, F.col(c)).alias(c) for c in ("has_text", "has_rad")])
    joined = subjects.join(img, "subject_id", "left").join(txt.drop("_n"), "subject_id", "left")
    flagged = joined.withColumn("has_struct", F.lit(1)).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in FLAGS if c != "has_struct"}
    )
    return flagged.select(
        *subjects.columns, *FLAGS, pattern_code().alias("pattern_code"), pattern_string().alias("missing_pattern")
    )


def pattern_histogram(df: DataFrame, code: str = "pattern_code") -> DataFrame:
    """Count and share per pattern code, ordered by code (at most 16 rows)."""
    counts = df.groupBy(code).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())  # over the at most 16 counts, not over the rows
    return counts.select(code, decode_pattern(code).alias("pattern"), "n", (F.col("n") * 100.0 / total).alias("pct")).orderBy(code)


def dataset_statistics(df: DataFrame, flags=FLAGS, labels=LABELS) -> DataFrame:
    """`(item, kind, n, pct)`: row count, availability per modality and label rates, from one aggregation."""
    n = F.count(F.lit(1))
    items = [F.struct(F.lit("rows").alias("item"), F.lit("total").alias("kind"), n.alias("n"), F.lit(100.0).alias("pct"))]
    for kind, cols in (("modality", flags), ("label", labels)):
        items += [
            F.struct(
                F.lit(c).alias("item"), F.lit(kind).alias("kind"), F.sum(F.col(c).cast("long")).alias("n"),
                (F.avg(F.col(c).cast("double")) * 100.0).alias("pct"),
            )
            for c in cols
        ]
    return df.agg(F.array(*items).alias("_i")).select(F.explode("_i").alias("s")).select("s.*")


def attach_vector(df: DataFrame, vectors: DataFrame, column: str, dim: int, ident: str = "subject_id") -> DataFrame:
    """Left-join one vector per subject; zeros where absent. `vectors` must be unique per id (see pooling)."""
    joined = df.join(vectors.select(ident, column), ident, "left")
    return joined.withColumn(column, F.coalesce(as_double(column), zeros(dim)))


def vectors_or_null(df: DataFrame, column: str) -> DataFrame:
    """An all-zero vector means "nothing usable" and becomes NULL."""
    return df.withColumn(column, F.when(F.exists(column, lambda x: x != 0), F.col(column)))
