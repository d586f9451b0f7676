"""Batch text embedding: clean, encode, pool per subject."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, preprocess_note, word_slots
from ..functions.vectors import l2_normalize, zeros
from ..session import materialize
from .modality import vectors_or_null
from .ordered import null_safe_join
from .pooling import pool_vectors

NOTE_TYPES = ("discharge", "radiology")
DEFAULT_DIM = 768

Encoder = Callable[[DataFrame, str, str], DataFrame]


NOTES_AT_ONCE = 1_000


def slot_weights(rows: DataFrame, slots: str, dim: int) -> np.ndarray:
    """`ln((notes + 1) / (notes with the slot + 1))` of each slot; the driver sees `dim` + 1 counts, which are added up map-side first."""
    every = F.lit(dim)  # one slot more, which each note has
    seen = rows.select(F.explode(F.concat(F.array_distinct(slots), F.array(every))).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(dim + 1)
    for r in seen.collect():
        counts[r["slot"]] = r["n"]
    return np.log((counts[dim] + 1) / (counts[:dim] + 1))


def hashing_encoder(dim: int = DEFAULT_DIM) -> Encoder:
    """Unit-length TF-IDF over md5 slots of words; the stand-in when no model is supplied.

    Slots are taken once and stored in place of the text: document frequencies and vectors both come from them. A note without words,
    or with nothing but words that every note has, gets the zero vector.
    """

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        rows = materialize(df.withColumn("_slots", word_slots(text, dim)).drop(text), "slots")
        weights = slot_weights(rows, "_slots", dim)

        @F.pandas_udf("array<double>")
        def weigh(slots: pd.Series) -> pd.Series:
            vectors = []
            for start in range(0, len(slots), NOTES_AT_ONCE):
                part = slots.iloc[start : start + NOTES_AT_ONCE].to_numpy()
                owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
                counts = np.bincount(owner * dim + np.concatenate(part).astype(np.int64), minlength=len(part) * dim).reshape(len(part), dim)
                x = counts * weights
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                vectors += list(np.divide(x, norm, out=np.zeros_like(x), where=norm > 0))
            return pd.Series(vectors, dtype=object)

        return rows.withColumn(out, weigh("_slots")).drop("_slots")

    return encode


def model_encoder(make_predict_fn: Callable, batch_size: int = 8, normalize: bool = True) -> Encoder:
    """Any model behind `make_predict_fn() -> fn(texts) -> 2-D array`, loaded once per Python worker.

    The texts of an Arrow batch go to the model by falling length, so texts of about one length share a model batch, little is padded
    and the largest batch comes first. Vectors return in the order of the rows.
    """

    def encode(df: DataFrame, text: str, out: str) -> DataFrame:
        @F.pandas_udf("array<double>")
        def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = make_predict_fn()
            for part in parts:
                texts = part.to_numpy()
                order = np.argsort([-len(t) for t in texts], kind="stable")
                vectors = np.empty(len(texts), dtype=object)
                for start in range(0, len(order), batch_size):
                    picked = order[start : start + batch_size]
                    for k, vector in zip(picked, np.asarray(model(texts[picked]), dtype=np.float64)):
                        vectors[k] = vector
                yield pd.Series(vectors)

        vec = predict(F.col(text))
        return df.withColumn(out, l2_normalize(vec) if normalize else vec)

    return encode


def embed_notes(
    notes: DataFrame, encoder: Encoder | None = None, strategy: str = "weighted_mean", dim: int = DEFAULT_DIM,
    keys: Sequence[str] = ("subject_id", "note_type"),
) -> DataFrame:
    """One pooled vector per key, NULL keys included. Keys whose notes are all blank get the zero vector."""
    encode = encoder or hashing_encoder(dim)
    clean = notes.select(*keys, preprocess_note("text").alias("_text"))
    usable = encode(clean.filter(~is_blank("_text")), "_text", "_emb").select(F.struct(*keys).alias("_key"), "_emb")
    pooled = pool_vectors(usable, "_key", "_emb", strategy, "embedding").select("_key.*", "embedding", "n_vectors")
    everyone = notes.select(*keys).distinct()
    return null_safe_join(everyone, pooled, keys, "left").select(
        *keys, F.coalesce("embedding", zeros(dim)).alias("embedding"), F.coalesce("n_vectors", F.lit(0)).alias("n_notes")
    )


def text_embedding_table(subjects: DataFrame, embedded: DataFrame) -> DataFrame:
    """`(subject_id, discharge_embedding, radiology_embedding)` for every subject, NULL where nothing usable."""
    per = embedded.groupBy("subject_id").agg(
        *[F.first(F.when(F.col("note_type") == t, F.col("embedding")), ignorenulls=True).alias(f"{t}_embedding") for t in NOTE_TYPES]
    )
    table = subjects.select("subject_id").join(per, "subject_id", "left")
    for t in NOTE_TYPES:
        table = vectors_or_null(table, f"{t}_embedding")
    return table
