"""Snapshots in buckets of the subject: layout, hot keys, and joins without an exchange of detail rows."""

import re

import pytest
from pyspark.sql import functions as F

from modalframe.operators import features as X
from modalframe.sources.bucketed import HOT_FACTOR, hot_keys, open_keyed, write_bucketed, write_keyed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def detail(spark):
    """Subject 7 holds a third of the rows; some subjects and admissions are NULL."""
    ids = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 101 == 0, None).otherwise(F.col("id") % 90).alias("subject_id"), F.col("id")
    )
    hadm = F.when(F.col("id") % 53 == 0, None).otherwise(F.col("subject_id") * 10 + F.floor(F.col("id") / 90) % 3)
    return ids.select("subject_id", hadm.alias("hadm_id"), F.concat(F.lit("c"), F.col("id") % 5).alias("icd_code"), F.col("id").alias("poe_id"),
        F.when(F.col("id") % 4 == 0, "ANTIBIOTIC x").alias("drug_type"), F.when(F.col("id") % 6 == 0, "ANTIBIOTIC").alias("event_txt"),
        (F.col("id") % 7).cast("double").alias("totalamount"), F.lit(1.0).alias("value"), (F.col("id") % 4).cast("int").alias("drg_severity"), F.lit("s").alias("drg_code"))


TABLES = ("diagnoses_icd", "prescriptions", "emar", "drgcodes", "inputevents", "outputevents")


def test_hot_keys_and_nothing_lost(spark, detail, tmp_path):
    path = f"file://{tmp_path}/t"
    assert [r[0] for r in hot_keys({"a": detail}, "subject_id", 16).collect()] == [7]
    write_keyed({"a": detail, "b": detail.limit(0)}, path, "subject_id", 16)
    stored = open_keyed(spark, path)
    assert rows(stored.table("a")) == rows(detail) and stored.table("b").count() == 0
    assert {r[0] for r in stored.hot["a"].select("subject_id").distinct().collect()} == {7}
    assert stored.tables["a"].filter("subject_id = 7").isEmpty()
    write_keyed({"a": detail.limit(1)}, path, "subject_id", 4)  # the stored copy wins
    assert open_keyed(spark, path).buckets == 16


def test_buckets_grow_with_the_rows(spark, detail, tmp_path):
    path = f"file://{tmp_path}/t"
    write_keyed({"a": detail, "b": detail}, path, "subject_id", 4, factor=HOT_FACTOR * 10, bucket_rows=500)
    stored = open_keyed(spark, path)
    assert stored.buckets == 12 and rows(stored.table("a")) == rows(detail)
    assert stored.tables["a"].groupBy(F.input_file_name()).count().agg(F.count("*")).first()[0] > 4


def test_null_may_be_the_hot_key(spark, tmp_path):
    df = spark.range(900).select(F.when(F.col("id") % 2 == 0, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    path = f"file://{tmp_path}/t"
    write_keyed({"a": df}, path, "k", 8)
    stored = open_keyed(spark, path)
    assert stored.hot["a"].count() == 450 and rows(stored.table("a")) == rows(df)


def test_another_session_learns_the_layout(spark, detail, tmp_path):
    path = f"file://{tmp_path}/t"
    write_keyed({"a": detail}, path, "subject_id", 8, factor=HOT_FACTOR * 10)
    before = open_keyed(spark, path)
    assert before.hot == {}
    for t in spark.catalog.listTables():
        if t.name.startswith("keyed_"):
            spark.sql(f"DROP TABLE {t.name}")  # the catalog forgets, the files stay
    grouped = open_keyed(spark, path).tables["a"].groupBy("subject_id", "hadm_id").count()
    assert "Exchange" not in plan(grouped) and grouped.agg(F.sum("count")).first()[0] == 3000


def test_a_broken_off_write_is_not_opened(spark, detail, tmp_path):
    path = f"file://{tmp_path}/t"
    write_bucketed(detail, "subject_id", 4, f"{path}/a")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        open_keyed(spark, path)


def test_frame_equals_the_plain_one_without_moving_details(spark, detail, tmp_path):
    path = f"file://{tmp_path}/t"
    pairs = spark.range(95).select(F.col("id").alias("subject_id"), F.when(F.col("id") != 20, F.col("id") * 10 + 1).alias("hadm_id"))
    # outputs of few subjects only: volumes with a missing side
    sources = {t: detail.filter("subject_id < 40") if t == "outputevents" else detail for t in TABLES}
    write_keyed(sources, path, "subject_id", 8, factor=100.0)
    stored = open_keyed(spark, path)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of real size
    try:
        here = write_bucketed(pairs.filter("hadm_id IS NOT NULL"), "subject_id", 8)
        got = X.colocated_frame(stored.tables, here)
        text = plan(got)
        assert "Exchange" not in text and text.count("Bucketed: true") >= len(TABLES)
        features = [c for c in got.columns if c not in X.PAIR]
        found = got.filter(F.coalesce(*[F.col(c).cast("string") for c in features]).isNotNull())
        want = X.combined_frame(sources, pairs).select(got.columns)
        assert rows(found) == rows(want) and found.count() > 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert not re.search("ArrowPython|BatchEval", text)
