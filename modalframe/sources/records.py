"""Vectors stored one per record file: `p{sid div 1e6}/p{sid}/{study}/*.tfrecord`.

`scan_records` reads them through a data source. Given a cohort, the source plans one partition per bundle of cohort subjects, and a task lists and
reads the folders of its own subjects only: folders of other subjects are never listed, and the driver sees neither ids nor file names.
A bundle holds the wanted number of subjects, or more where there would be over `MOST_BUNDLES` bundles.
Without a cohort it plans shares of the top folders (one for each million subjects), and filters on `subject_id` prune them.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pa_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..session import materialize_at, qualified

SUBJECTS_PER_FOLDER = 1_000_000
FEATURE = "embedding"
CHECKED = 256  # files whose checksums advance together
MOST_BUNDLES = 1000  # of a cohort, and one more for each of its files
PATH_PATTERN = r"p\d+/p(\d+)/([^/]+)/([^/]+)\.tfrecord$"


def subject_folder(subject: Column | str) -> Column:
    sid = F.col(subject) if isinstance(subject, str) else subject
    return F.format_string("p%d/p%d", F.floor(sid / SUBJECTS_PER_FOLDER).cast("long"), sid)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def masked_crcs(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, rotated and offset as record files store it.

    All parts advance together, one byte place a step; longer parts come first, so the ones still running are a prefix.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    most = int(sizes.max(initial=0))
    crc = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    columns = np.zeros((most, len(parts)), np.uint8)
    for rank, k in enumerate(order.tolist()):
        columns[: sizes[k], rank] = np.frombuffer(parts[k], np.uint8)
    running = np.searchsorted(-sizes[order], -np.arange(most), side="left")
    for place in range(most):
        n = running[place]
        crc[:n] = _CRC[(crc[:n] ^ columns[place, :n]) & 0xFF] ^ (crc[:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    out = np.empty(len(parts), np.uint32)
    out[order] = ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(0xA282EAD8)
    return out


def masked_crc(data: bytes) -> int:
    return int(masked_crcs([data])[0])


def first_records(contents: list[bytes]) -> list[bytes | None]:
    """Payload of the first record of each file (length, its checksum, payload, its checksum), or None if it is corrupt."""
    heads, payloads, wanted = [], [], []
    for content in contents:
        whole = len(content) >= 12
        size, size_crc = struct.unpack_from("<QI", content, 0) if whole else (0, 0)
        payload = content[12 : 12 + size]
        whole = whole and len(payload) == size and len(content) >= 16 + size
        heads.append(content[:8])
        payloads.append(payload if whole else b"")
        wanted.append((size_crc, *struct.unpack_from("<I", content, 12 + size)) if whole else None)
    checks = zip(masked_crcs(heads).tolist(), masked_crcs(payloads).tolist())
    return [p if w == c else None for p, w, c in zip(payloads, wanted, checks)]


def first_record(content: bytes) -> bytes:
    struct.unpack_from("<QI", content, 0)  # too short for a header: struct.error
    (payload,) = first_records([content])
    if payload is None:
        raise ValueError("corrupt record")
    return payload


def _fields(buf: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field number, wire type, value) of a protocol-buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 0x7F) << shift
            i, shift = i + 1, shift + 7
            if b < 0x80:
                return value, i

    i = 0
    while i < len(buf):
        tag, i = varint(i)
        field, wire = tag >> 3, tag & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, i = buf[i : i + size], i + size
        else:
            raise ValueError(f"unsupported wire type {wire}")
        yield field, wire, value


def decode_vector(content: bytes, feature: str = FEATURE) -> list[float]:
    """The float list stored under `feature` in the first record (empty when the feature is absent)."""
    return decode_payload(first_record(content), feature)


def decode_payload(payload: bytes, feature: str = FEATURE) -> list[float]:
    out: list[float] = []
    for f, _, features in _fields(payload):
        if f != 1:
            continue
        for _, _, entry in _fields(features):
            parts = {k: v for k, _, v in _fields(entry)}
            if parts.get(1) != feature.encode():
                continue
            for kind, _, float_list in _fields(parts.get(2, b"")):
                if kind == 2:
                    for _, _, packed in _fields(float_list):
                        out.extend(np.frombuffer(packed, dtype="<f4").tolist())
    return out


def decode_contents(contents: list[bytes], feature: str = FEATURE) -> tuple[list[list[float] | None], list[str | None]]:
    """(vectors, errors) of files: one of the two is None for each; an unreadable file is reported, not fatal."""
    vectors, errors = [], []
    for payload in (p for k in range(0, len(contents), CHECKED) for p in first_records(contents[k : k + CHECKED])):
        try:
            if payload is None:
                raise ValueError("corrupt record")
            vectors.append(decode_payload(payload, feature))
            errors.append(None)
        except Exception as e:  # noqa: BLE001
            vectors.append(None)
            errors.append(f"{type(e).__name__}: {e}")
    return vectors, errors


def decode_records(files: DataFrame) -> DataFrame:
    """`(path, content)` -> `(subject_id, study_id, file, embedding, error)`; `error` is NULL for good files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vectors, errors = decode_contents([bytes(c) for c in batch["content"]])
            yield pd.DataFrame({"path": batch["path"], "embedding": vectors, "error": pd.Series(errors, dtype=object)})

    raw = files.select("path", "content").mapInPandas(decode, "path string, embedding array<float>, error string")
    return raw.select(
        F.regexp_extract("path", PATH_PATTERN, 1).cast("long").alias("subject_id"),
        F.regexp_extract("path", PATH_PATTERN, 2).alias("study_id"),
        F.regexp_extract("path", PATH_PATTERN, 3).alias("file"),
        "embedding",
        "error",
    )


def open_store(uri: str) -> tuple[pa_fs.FileSystem, str]:
    """File system and path of a qualified location."""
    if uri.startswith("file:"):
        return pa_fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pa_fs.FileSystem.from_uri(uri) if ":" in uri else (pa_fs.LocalFileSystem(), uri)


@dataclass
class Bundle(InputPartition):
    """Rows [start, stop) of a stored cohort file, or share `start` of `stop` of one top folder."""

    source: str
    start: int
    stop: int
    of_cohort: bool


class PlainRecordReader(DataSourceReader):
    """Reads records without taking filters; Spark refuses a reader that takes them in sessions where filter pushdown is off."""

    def __init__(self, base: str, cohort: str | None, bundle: int, shares: int, feature: str) -> None:
        self.base, self.cohort, self.bundle, self.shares, self.feature = base, cohort, bundle, shares, feature
        self.low, self.high, self.chosen = float("-inf"), float("inf"), None

    def wanted(self, subject: int) -> bool:
        return self.low <= subject <= self.high and (self.chosen is None or subject in self.chosen)

    def partitions(self):
        store, root = open_store(self.cohort or self.base)
        entries = store.get_file_info(pa_fs.FileSelector(root, allow_not_found=True))
        if self.cohort:
            sizes = {e.path: pq.read_metadata(e.path, filesystem=store).num_rows for e in entries if e.path.endswith(".parquet")}
            step = max(self.bundle, -(-sum(sizes.values()) // MOST_BUNDLES))
            return [Bundle(path, at, min(at + step, n), True) for path, n in sorted(sizes.items()) for at in range(0, n, step)]
        out = []
        for e in sorted(entries, key=lambda e: e.path):
            if e.type == pa_fs.FileType.Directory and re.fullmatch(r"p\d+", e.base_name):
                first = int(e.base_name[1:]) * SUBJECTS_PER_FOLDER
                inside = self.low < first + SUBJECTS_PER_FOLDER and first <= self.high
                if inside and (self.chosen is None or any(c // SUBJECTS_PER_FOLDER == first // SUBJECTS_PER_FOLDER for c in self.chosen)):
                    out += [Bundle(e.path, k, self.shares, False) for k in range(self.shares)]
        return out

    def subjects(self, part: Bundle) -> Iterator[int]:
        if part.of_cohort:
            store, _ = open_store(self.cohort)
            with pq.ParquetFile(part.source, filesystem=store) as file:
                at = 0
                for batch in file.iter_batches(columns=["subject_id"]):
                    if at >= part.stop:
                        break
                    own = batch.column(0).slice(max(0, part.start - at), max(0, part.stop - max(at, part.start)))
                    yield from (i for i in own.to_pylist() if i is not None and i >= 0)
                    at += len(batch)
        else:
            store, _ = open_store(self.base)
            for e in store.get_file_info(pa_fs.FileSelector(part.source)):
                if re.fullmatch(r"p\d+", e.base_name) and int(e.base_name[1:]) % part.stop == part.start:
                    yield int(e.base_name[1:])

    def read(self, partition: Bundle):
        store, root = open_store(self.base)
        found: list[tuple[int, str, str, bytes]] = []
        for subject in filter(self.wanted, self.subjects(partition)):
            folder = f"{root}/p{subject // SUBJECTS_PER_FOLDER}/p{subject}"
            for e in sorted(store.get_file_info(pa_fs.FileSelector(folder, recursive=True, allow_not_found=True)), key=lambda e: e.path):
                steps = e.path[len(folder) + 1 :].split("/")
                if e.type == pa_fs.FileType.File and len(steps) == 2 and steps[1].endswith(".tfrecord"):
                    with store.open_input_stream(e.path) as file:
                        found.append((subject, steps[0], steps[1].removesuffix(".tfrecord"), file.read()))
                    if len(found) >= CHECKED:
                        yield self.batch(found)
                        found = []
        if found:
            yield self.batch(found)

    def batch(self, found: list[tuple[int, str, str, bytes]]) -> pa.RecordBatch:
        subjects, studies, files, contents = zip(*found)
        vectors, errors = decode_contents(list(contents), self.feature)
        columns = [pa.array(subjects, pa.int64()), pa.array(studies), pa.array(files), pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["subject_id", "study_id", "file", "embedding", "error"])


class RecordReader(PlainRecordReader):
    """Takes filters on `subject_id` to prune the folders."""

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        """Comparisons of `subject_id` with values prune the listing; all others are left to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("subject_id",):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, In):
                values = set(f.value)
                self.chosen = values if self.chosen is None else self.chosen & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f


class RecordFiles(DataSource):
    """Format `record_files`: `path`, and optionally `cohort` (a stored table of `subject_id`), `bundle` (subjects a partition), `shares`, `feature`, and
    `pushdown` (true only where the session pushes filters to Python data sources)."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "subject_id long, study_id string, file string, embedding array<float>, error string"

    def reader(self, schema) -> PlainRecordReader:
        o = self.options
        kind = RecordReader if o.get("pushdown", "false").lower() == "true" else PlainRecordReader
        return kind(o["path"], o.get("cohort"), int(o.get("bundle", 2000)), int(o.get("shares", 8)), o.get("feature", FEATURE))


def scan_records(spark: SparkSession, base_dir: str, subjects: DataFrame | None = None, bundle: int = 2000) -> DataFrame:
    """Every record file below `base_dir` as `(subject_id, study_id, file, embedding, error)`; with `subjects`, only theirs are listed and read.

    The cohort's distinct ids are stored once, by a hash, so that neighbours with many files fall to different tasks; tasks read their slice of them. Filters prune folders where the session pushes them down
    (`spark.sql.python.filterPushdown.enabled`), else Spark applies them to the rows. For stores that only Spark reaches use `scan_records_by_spark`.
    """
    spark.dataSource.register(RecordFiles)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(RecordFiles.name()).option("bundle", bundle).option("pushdown", pushdown)
    if subjects is not None:
        ids = subjects.select(F.col("subject_id").cast("long")).where("subject_id is not null").distinct()
        _, path = materialize_at(ids.repartition("subject_id").sortWithinPartitions(F.xxhash64("subject_id")), "cohort")
        reader = reader.option("cohort", qualified(spark, path))
    return reader.load(qualified(spark, base_dir))


def scan_records_by_spark(spark: SparkSession, base_dir: str, subjects: DataFrame | None = None) -> DataFrame:
    """The same rows through Spark's own file listing: all file names are listed, contents are read for `subjects` only after a semi-join of the paths."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.tfrecord").option("recursiveFileLookup", "true").load(base_dir)
    if subjects is not None:
        listed = listed.withColumn("subject_id", F.regexp_extract("path", PATH_PATTERN, 1).try_cast("long"))
        listed = listed.join(subjects.select("subject_id"), "subject_id", "left_semi")
    return decode_records(listed)


def readable(records: DataFrame) -> DataFrame:
    return records.filter(F.col("error").isNull()).drop("error")
