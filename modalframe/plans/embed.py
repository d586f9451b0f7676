"""Stage 2: pooled note and image vectors per subject."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cohort import restrict_to_subjects
from ..operators.embedding import DEFAULT_DIM, Encoder, embed_notes, text_embedding_table
from ..operators.pooling import pool_vectors


def text_table(notes: DataFrame, subjects: DataFrame, encoder: Encoder | None = None, dim: int = DEFAULT_DIM) -> DataFrame:
    """`(subject_id, discharge_embedding, radiology_embedding)`, ordered by subject, for all subjects."""
    kept = restrict_to_subjects(notes, subjects)
    return text_embedding_table(subjects, embed_notes(kept, encoder, dim=dim)).orderBy("subject_id")


def image_table(vectors: DataFrame, subjects: DataFrame, strategy: str = "mean") -> DataFrame:
    """`(subject_id, agg_embedding)` for subjects with at least one image vector."""
    kept = vectors.join(subjects.select("subject_id"), "subject_id", "left_semi")
    return pool_vectors(kept, "subject_id", "embedding", strategy, "agg_embedding").drop("n_vectors")
