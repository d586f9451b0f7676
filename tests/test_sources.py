import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.record_fixture import encode_vector, encode_vectors
from modalframe.sources import records, sinks, tables
from modalframe.sources.wide import from_wide, to_wide


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb" if isinstance(text, bytes) else "w") as f:
        f.write(text)
    return str(path)


def test_csv_readers(spark, tmp_path):
    p = write(f"{tmp_path}/a.csv", "id,t,x\n1,2020-01-02 03:04:05,1.5\n2,,\n")
    rows = tables.read_csv(spark, p, "id long, t timestamp_ntz, x double").orderBy("id").collect()
    assert rows[0]["t"].hour == 3 and rows[1]["t"] is None and rows[1]["x"] is None
    p = write(f"{tmp_path}/b.csv", 'id,v\n1,"a, \\"q\\" b"\n2,"two\nlines"\nx,bad\n3,ok\n')
    good, bad = tables.read_csv_tolerant(spark, p, T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())]))
    assert {r["id"]: r["v"] for r in good.collect()} == {1: 'a, "q" b', 2: "two\nlines", 3: "ok"}
    assert [r[0] for r in bad.collect()] == ["x,bad"]


def test_tables_snapshot_and_missing(spark, tmp_path):
    df = spark.range(10).selectExpr("id AS subject_id", "id * 2 AS v")
    path = f"{tmp_path}/t"
    sinks.write_table(df, path)
    ids = spark.createDataFrame([(3,), (4,)], "subject_id long")
    assert tables.read_table(spark, path, ids).count() == 2
    assert tables.read_table(spark, path, limit=4).count() == 4
    found, failed = tables.read_dictionaries(spark, {"good": path, "gone": f"{tmp_path}/none"})
    assert list(found) == ["good"] and list(failed) == ["gone"]
    snap = f"{tmp_path}/snap"
    assert tables.snapshot(ids, snap).count() == 2
    assert tables.snapshot(df, snap).count() == 2  # the stored copy wins
    empty = tables.read_or_empty(spark, f"{tmp_path}/none", df.schema)
    assert empty.count() == 0 and empty.columns == df.columns
    assert tables.read_or_empty(spark, path, df.schema).count() == 10


def test_prediction_reader(spark, tmp_path):
    p = write(f"{tmp_path}/p.csv", "subject_id,readmission_prediction\ntensor(12),0.5\n7,0.25\n")
    rows = {r["subject_id"]: r for r in tables.read_predictions(spark, p).collect()}
    assert set(rows) == {12, 7} and rows[12]["has_rad"] == 1
    p = write(f"{tmp_path}/q.csv", "subject_id,has_struct,has_img,has_text,has_rad\n1,1.0,0.0,1.0,0.0\n")
    row = tables.read_predictions(spark, p).first()
    assert (row["has_img"], row["has_text"]) == (0, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.5, 1.0], "a,\"b\"")], "id long, v array<double>, s string")
    sinks.write_csv(df, f"{tmp_path}/c")
    back = spark.read.csv(f"{tmp_path}/c", header=True, escape='"').first()
    assert back["v"] == "[0.5,1.0]" and back["s"] == 'a,"b"'
    sinks.write_metrics(df.select("id"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first()["id"] == 1


def test_wide_layout_round_trip(spark):
    df = spark.createDataFrame([(1, 2, [0.1, 0.2]), (1, 1, [0.3, 0.4]), (2, 1, [1.0, 2.0]), (3, 1, None)], "id long, k int, v array<double>")
    wide = to_wide(df, "id", "v", ["k"])
    rows = {r["id"]: r for r in wide.collect()}
    assert wide.columns == ["id", "file_0", "file_1"] and rows[1]["file_0"] == "[0.300000,0.400000]" and rows[2]["file_1"] == ""
    back = {(r["id"], r["pos"]): r["embedding"] for r in from_wide(wide, "id").collect()}
    assert back == {(1, 0): [0.3, 0.4], (1, 1): [0.1, 0.2], (2, 0): [1.0, 2.0]}


def test_record_scan(spark, tmp_path):
    rng = np.random.default_rng(0)
    vec = rng.normal(size=200).astype(np.float32)
    good = encode_vector(vec)
    flipped = bytearray(good)
    flipped[40] ^= 1
    base = f"{tmp_path}/files"
    write(f"{base}/p10/p10000032/s1/a.tfrecord", good + good)  # only the first record counts
    write(f"{base}/p10/p10000032/s2/b.tfrecord", bytes(flipped))
    write(f"{base}/p0/p7/s3/c.tfrecord", b"xx")
    write(f"{base}/p0/p7/s3/d.tfrecord", encode_vector(vec[:3]))
    write(f"{base}/p0/p7/s3/note.txt", "x")
    out = {(r["subject_id"], r["study_id"], r["file"]): r for r in records.scan_records(spark, base).collect()}
    assert out[(10000032, "s1", "a")]["embedding"] == pytest.approx(vec.tolist())
    assert "corrupt" in out[(10000032, "s2", "b")]["error"] and out[(7, "s3", "c")]["error"] is not None
    only = records.readable(records.scan_records(spark, base, spark.createDataFrame([(7,), (8,)], "subject_id long"))).collect()
    assert [(r["subject_id"], r["file"]) for r in only] == [(7, "d")]
    by_spark = {(r["subject_id"], r["study_id"], r["file"]) for r in records.scan_records_by_spark(spark, base).collect()}
    assert by_spark == set(out) and records.readable(records.scan_records_by_spark(spark, base, spark.createDataFrame([(7,)], "subject_id long"))).count() == 1
    folders = spark.createDataFrame([(10000032,), (7,)], "s long").select(records.subject_folder("s").alias("f")).collect()
    assert [r["f"] for r in folders] == ["p10/p10000032", "p0/p7"]


def test_record_scan_lists_cohort_folders_only(spark, tmp_path):
    base = f"{tmp_path}/files"
    for sid in range(40):
        write(f"{base}/p0/p{sid}/s1/v.tfrecord", encode_vector(np.full(4, sid, np.float32)))
    write(f"{base}/p3/p3000001/s1/v.tfrecord", encode_vector(np.zeros(2, np.float32)))
    cohort = spark.createDataFrame([(3,), (5,), (3,), (None,), (77,)], "subject_id long")
    got = records.scan_records(spark, base, cohort, bundle=1)
    assert sorted(r["subject_id"] for r in got.collect()) == [3, 5]
    ranges = records.RecordReader(base, None, 10, 4, "embedding")
    assert len(ranges.partitions()) == 8
    left = list(ranges.pushFilters([records.GreaterThan(("subject_id",), 37), records.LessThan(("subject_id",), 1000), records.EqualTo(("file",), "v")]))
    assert len(left) == 1 and len(ranges.partitions()) == 4
    assert sorted(s for p in ranges.partitions() for b in ranges.read(p) for s in b.column(0).to_pylist()) == [38, 39]
    picked = records.RecordReader(base, None, 10, 2, "embedding")
    assert not list(picked.pushFilters([records.In(("subject_id",), (1, 3000001))]))
    assert sorted(s for p in picked.partitions() for b in picked.read(p) for s in b.column(0).to_pylist()) == [1, 3000001]
    plain = records.scan_records(spark, base).where("subject_id >= 39")
    assert sorted(r["subject_id"] for r in plain.collect()) == [39, 3000001]


def test_record_scan_without_filter_pushdown(spark, tmp_path):
    base = f"{tmp_path}/files"
    for sid in range(4):
        write(f"{base}/p0/p{sid}/s1/v.tfrecord", encode_vector(np.full(4, sid, np.float32)))
    setting = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        cohort = spark.createDataFrame([(1,), (3,)], "subject_id long")
        got = records.scan_records(spark, base, cohort).where("subject_id >= 2 and error is null")
        assert [r["subject_id"] for r in got.collect()] == [3]
        assert sorted(r["subject_id"] for r in records.scan_records(spark, base).where("subject_id >= 2").collect()) == [2, 3]
    finally:
        spark.conf.set(setting, before)


def test_large_cohorts_are_read_in_few_bundles(spark, tmp_path, monkeypatch):
    """Bundles grow with the cohort, hold every subject once, and each is read as a slice of the stored ids."""
    base, path = f"{tmp_path}/files", f"{tmp_path}/cohort"
    for sid in (0, 70_001, 199_999):
        write(f"{base}/p0/p{sid}/s1/v.tfrecord", encode_vector(np.full(4, sid, np.float32)))
    spark.range(200_000).select(F.col("id").alias("subject_id")).coalesce(2).write.parquet(path)
    reader = records.RecordReader(base, path, 16, 8, "embedding")
    parts = reader.partitions()
    assert len(parts) <= 1002 and sum(p.stop - p.start for p in parts) == 200_000
    some = parts[::400] + parts[-1:]
    assert [len(list(reader.subjects(p))) for p in some] == [p.stop - p.start for p in some]
    last = [s for p in parts[-3:] for s in reader.subjects(p)]
    assert last == list(range(200_000 - len(last), 200_000))
    monkeypatch.setattr(records, "MOST_BUNDLES", 3)
    got = [s for p in reader.partitions() for b in reader.read(p) for s in b.column(0).to_pylist()]
    assert got == [0, 70_001, 199_999] and len(reader.partitions()) <= 5


def test_neighbours_are_dealt_to_different_bundles(spark, tmp_path):
    """Subjects with files may be neighbours in an ordered cohort: they are not read by a few tasks."""
    base = f"{tmp_path}/files"
    for sid in range(40):
        write(f"{base}/p0/p{sid}/s1/v.tfrecord", encode_vector(np.full(2, sid, np.float32)))
    got = records.scan_records(spark, base, spark.range(4000).select(F.col("id").alias("subject_id")).orderBy("subject_id"), bundle=40)
    rows = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in rows) == 40 and len(rows) > 15 and max(r["count"] for r in rows) < 10


def test_record_scan_over_many_customers(spark, tmp_path):
    """The query's tasks do not grow with the customers: 40,000 of them, 32,000 in the cohort, would be 2,000 bundles of 16."""
    from catalog.q_models import scanned

    keys = spark.range(40_000)
    keys.select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    orders = keys.select(F.col("id").alias("o_custkey"), F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.withColumn("o_orderdate", F.expr("date'2000-01-01'")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, [0.5, 0.25 * k]) for k in range(6)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert 900 < scanned(spark, str(tmp_path)).rdd.getNumPartitions() <= 1100


def test_vectors_encoded_together():
    rng = np.random.default_rng(1)
    vectors = [rng.normal(size=n).astype(np.float32) for n in (3, 0, 64, 1)]
    files = encode_vectors(vectors)
    assert files == [encode_vector(v) for v in vectors]
    assert [records.decode_vector(f) for f in files] == [v.tolist() for v in vectors]


def test_checksum_and_other_features():
    assert records.masked_crc(b"123456789") == ((0xE3069283 >> 15 | 0xE3069283 << 17) + 0xA282EAD8) & 0xFFFFFFFF
    assert records.decode_vector(encode_vector([1.0], "other")) == []
    with pytest.raises(struct.error):
        records.decode_vector(b"abc")


def test_correct_job(spark, tmp_path):
    import importlib
    import sys

    from test_correction import frame

    src = f"{tmp_path}/pred"
    sinks.write_table(frame(spark), src)
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "jobs"))
    importlib.import_module("correct").main(["--csv_path", src, "--selective", "--output_prefix", f"{tmp_path}/out"])
    back = spark.read.csv(f"{tmp_path}/out_selective_results", header=True, inferSchema=True)
    assert back.count() == frame(spark).count() and "readm_pred_corrected" in back.columns
    assert spark.read.json(f"{tmp_path}/out_selective_metrics").count() == 6
    assert spark.read.parquet(f"{tmp_path}/out_selective_roc").filter(F.col("threshold").isNull()).count() == 2


def test_prediction_file_with_bad_lines(spark, tmp_path):
    p = write(f"{tmp_path}/p.csv", "subject_id,readmission_prediction,has_img\ntensor(12),0.5,1\nx,0.25,1\n7,zero,1\n8,0.5,1,9\n9,0.75\n,0.5,0\n")
    got = tables.read_prediction_file(spark, p)
    assert [r["subject_id"] for r in got.rows.collect()] == [12]
    assert sorted(r["reason"] for r in got.rejected.collect()) == ["malformed line"] * 3 + ["no id"] * 2
    assert {r["line"] for r in got.rejected.collect()} >= {"7,zero,1", "8,0.5,1,9", "9,0.75"}
    assert got.counts == {"lines": 6, "malformed": 3, "no_id": 2}
