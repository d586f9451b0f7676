"""Record files for the scan queries and tests: the embeddings as one file each, with damaged twins."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modalframe.session import new_path, qualified
from modalframe.sources.records import CHECKED, FEATURE, masked_crcs, open_store, subject_folder


def encode_vectors(vectors: Sequence[np.ndarray], feature: str = FEATURE) -> list[bytes]:
    """One-record files holding `vectors` under `feature`; their checksums advance together."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n >= 0x80:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    def field(number: int, body: bytes) -> bytes:
        return varint(number << 3 | 2) + varint(len(body)) + body

    def payload(vector: np.ndarray) -> bytes:
        floats = field(1, np.asarray(vector, dtype="<f4").tobytes())
        entry = field(1, feature.encode()) + field(2, field(2, floats))
        return field(1, field(1, entry))

    payloads = [payload(v) for v in vectors]
    sizes = [struct.pack("<Q", len(p)) for p in payloads]
    checks = zip(masked_crcs(sizes).tolist(), masked_crcs(payloads).tolist())
    return [size + struct.pack("<I", a) + p + struct.pack("<I", b) for size, p, (a, b) in zip(sizes, payloads, checks)]


def encode_vector(vector: np.ndarray, feature: str = FEATURE) -> bytes:
    """A one-record file holding `vector` under `feature` (the inverse of `modalframe.sources.records.decode_vector`)."""
    return encode_vectors([vector], feature)[0]


def write_records(spark: SparkSession, images: DataFrame) -> str:
    """Write every vector of `images` (subject_id, study_id, vec_id, embedding) as a record file in the shared folder and return that folder.

    A vector whose first entry is negative gets a twin `<vec_id>-flipped` with one bit changed, one whose second entry is negative a
    twin `<vec_id>-cut` that ends early.
    """
    base = qualified(spark, new_path(spark, "records"))

    def write(batches):
        store, root = open_store(base)
        for batch in batches:
            vectors = batch["embedding"].tolist()
            contents = (c for k in range(0, len(vectors), CHECKED) for c in encode_vectors(vectors[k : k + CHECKED]))
            for folder, vec_id, vector, content in zip(batch["folder"], batch["vec_id"], vectors, contents):
                store.create_dir(f"{root}/{folder}", recursive=True)
                flipped = bytes([*content[:40], content[40] ^ 1, *content[41:]])
                twins = {"": content} | ({"-flipped": flipped} if vector[0] < 0 else {}) | ({"-cut": content[:-9]} if vector[1] < 0 else {})
                for name, body in twins.items():
                    with store.open_output_stream(f"{root}/{folder}/{vec_id}{name}.tfrecord") as file:
                        file.write(body)
            yield pd.DataFrame({"n": [len(batch)]})

    folder = F.concat(subject_folder("subject_id"), F.lit("/s"), "study_id")
    images.select(folder.alias("folder"), "vec_id", "embedding").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return base
