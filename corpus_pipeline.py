"""A corpus cleaned in five stages, each over all that the one before kept.

Quality classifier (rejected documents go), SimHash near-duplicates (the first of each group stays), benchmark decontamination
(contaminated documents go), secret scans (secrets are replaced in the text), SentencePiece encoding (columns ids, n_ids and
round_trip are added). Stages 1 to 4 return the columns of their input; nulls, empty texts and repeated rows are treated as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from modalframe.llm.common import store, table
from modalframe.llm.decontam import drop_contaminated
from modalframe.llm.pieces import encode_texts
from modalframe.llm.quality import keep_good
from modalframe.llm.secrets import redact
from modalframe.llm.simhash import keep_representatives

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs, PIECE_MODEL)


STAGES = [
    ("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("encoding", encoding),
]

#: No stage but the third could be said in SQL: classifier, XXH64 fingerprints, battery and segmentation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, name)
    return docs
