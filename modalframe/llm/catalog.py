"""The registered queries of this subpackage. Where SQL can say the same, ORACLES holds DuckDB text."""

from __future__ import annotations

import corpus_pipeline

from .common import table
from .decontam import decontaminate
from .lm import score_texts
from .merkle import ORACLE as MERKLE_ORACLE
from .merkle import manifest_digest
from .metric import near_vectors
from .personal import find_personal_data
from .pieces import encode_texts
from .quality import score_quality
from .secrets import find_secrets
from .simhash import simhash_components
from .suffixes import remove_repeats
from .toxicity import score_toxicity
from .transducer import count_tokens
from .whitening import whiten_digest

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MERGE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op2_suffix_array_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False).drop("kept")


@query
def op3_lm_scoring(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), RANKS)


@query
def op4_quality_classifier(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_simhash_near_dedup(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


@query
def op6_benchmark_decontamination(spark, sf_dir):
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_secret_scans(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


@query
def op8_sentencepiece(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"), PIECE_MODEL, keep=["doc_id"])


@query
def op9_personal_data(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))


@query
def op10_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), MERGE_MODEL)


@query
def op12_embedding_whitening(spark, sf_dir):
    return whiten_digest(table(spark, sf_dir, "embeddings"))


@query
def op13_merkle_manifest(spark, sf_dir):
    return manifest_digest(table(spark, sf_dir, "documents"))


ORACLES["op13_merkle_manifest"] = MERKLE_ORACLE


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
