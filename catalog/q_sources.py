"""Readers and writers: files written from the views to the shared folder and read back; input hygiene on odd values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from modalframe.functions import vectors as V
from modalframe.functions.numeric import round_to
from modalframe.operators import rectifier
from modalframe.operators.cohort import eligible_subjects
from modalframe.session import new_path
from modalframe.sources import sinks, tables

from .q_vectors import E, EXPLODED, long_form, r5
from .registry import query, r6, sql
from .views import view

_COHORT = "p.anchor_year_group IN ('2008 - 2010', '2011 - 2013', '2014 - 2016', '2017 - 2019')"
_NAMES = ("subject_id", "readmission_prediction", "readmission_target", "icu_prediction", "icu_target")
#: which lines of the written file are spoilt, and how
_BAD_NUMBER, _EXTRA_FIELD, _NO_ID = "icu_prediction < 0.01", "mortality_prediction < 0.01", "has_rad = 1"


def prediction_lines(spark, sf_dir):
    """v_predictions as CSV lines with a header in each file: some ids wrapped, some without a number, some lines with a bad number or a field too many."""
    rows = view(spark, sf_dir, "v_predictions")
    ident = F.expr(f"CASE WHEN {_NO_ID} THEN 'unknown' WHEN has_img = 1 THEN concat('tensor(', subject_id, ')') ELSE CAST(subject_id AS STRING) END")
    icu = F.expr(f"CASE WHEN {_BAD_NUMBER} THEN 'n/a' ELSE CAST(icu_prediction AS STRING) END")
    last = F.expr(f"concat(icu_target, CASE WHEN {_EXTRA_FIELD} THEN ',more' ELSE '' END)")
    lines = rows.select(F.concat_ws(",", ident, "readmission_prediction", "readmission_target", icu, last).alias("line"))
    path = f"{new_path(spark, 'lines')}.csv"

    def with_header(batches):
        first = True
        for batch in batches:
            yield pd.DataFrame({"line": [",".join(_NAMES)] if first else []}, dtype=object)
            first = False
            yield batch

    lines.mapInPandas(with_header, "line string").write.text(path)
    return tables.read_prediction_file(spark, path)


_BAD = f"({_BAD_NUMBER} OR {_EXTRA_FIELD})"


@query("predictions_read", sql(("v_predictions",), [], f"""SELECT subject_id, {r6('readmission_prediction')} AS readmission_prediction, CAST(icu_target AS DOUBLE) AS icu_target,
 CAST(1 AS INT) AS has_img FROM v_predictions WHERE NOT {_BAD} AND NOT {_NO_ID}"""))
def predictions_read(spark, sf_dir):
    rows = prediction_lines(spark, sf_dir).rows
    return rows.select("subject_id", round_to("readmission_prediction").alias("readmission_prediction"), "icu_target", "has_img")


@query("predictions_rejected", sql(("v_predictions",), [], f"""SELECT CASE WHEN {_BAD} THEN 'malformed line' ELSE 'no id' END AS reason, CASE WHEN {_NO_ID} THEN 'unknown' WHEN has_img = 1 THEN 'tensor(' || subject_id || ')'
 ELSE CAST(subject_id AS VARCHAR) END AS ident, (SELECT count(*) FROM v_predictions) AS lines FROM v_predictions WHERE {_BAD} OR {_NO_ID}"""))
def predictions_rejected(spark, sf_dir):
    found = prediction_lines(spark, sf_dir)
    ident = F.coalesce(F.get_json_object("line", "$._id"), F.regexp_extract("line", r'^([^,{]*),|"subject_id":"([^"]*)"', 0))
    ident = F.regexp_replace(F.regexp_replace(ident, '^"subject_id":"|"$', ""), ",$", "")
    return found.rejected.select("reason", ident.alias("ident"), F.lit(found.counts["lines"]).cast("long").alias("lines"))


@query("rectifier_hygiene", sql(("v_odd_predictions",), [], f"""SELECT subject_id, {r6('least(greatest(score, 0.0), 1.0)')} AS score, least(greatest(CASE WHEN label = 0.5 THEN 0.0 WHEN label = 1.5 THEN 2.0 ELSE label END, 0.0), 1.0)::DOUBLE AS label
 FROM v_odd_predictions WHERE score IS NOT NULL AND label IS NOT NULL AND isfinite(score)"""))
def rectifier_hygiene(spark, sf_dir):
    return rectifier.gold_rows(view(spark, sf_dir, "v_odd_predictions"), "score", "label").select("subject_id", round_to("score").alias("score"), "label")


@query("vec_nan_to_zero", sql(E, [EXPLODED], f"SELECT vec_id, CAST(pos AS INT) AS pos, {r5('CASE WHEN abs(x) > 0.1::DOUBLE THEN 0.0 ELSE x END')} AS value FROM ex"))
def vec_nan_to_zero(spark, sf_dir):
    odd = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(x > 0.1, F.lit(float("nan"))).when(x < -0.1, F.lit(None)).otherwise(x))
    rows = view(spark, sf_dir, "v_image_embeddings").select("vec_id", odd.alias("v"))
    return long_form(rows.select("vec_id", V.nan_to_zero("v").alias("v")), ["vec_id"], "v")


@query("table_round_trip", sql(("v_admissions", "v_patients"), [], f"""SELECT a.subject_id, count(*) AS n, min(a.hadm_id) AS first_hadm FROM v_admissions a JOIN v_patients p ON a.subject_id = p.subject_id
 WHERE {_COHORT} GROUP BY a.subject_id"""))
def table_round_trip(spark, sf_dir):
    """Written as a table, kept as a snapshot (a later write of other rows does not replace it), read back for the cohort; a missing table adds nothing."""
    source = view(spark, sf_dir, "v_admissions").select("subject_id", "hadm_id")
    path = new_path(spark, "round_trip")
    sinks.write_table(source, f"{path}/admissions")
    tables.snapshot(source, f"{path}/snapshot")
    kept = tables.snapshot(source.limit(0), f"{path}/snapshot")
    missing = tables.read_or_empty(spark, f"{path}/none", source.schema)
    ids = eligible_subjects(view(spark, sf_dir, "v_patients"), view(spark, sf_dir, "v_admissions"))
    read = tables.read_table(spark, f"{path}/admissions", ids).join(kept.select("hadm_id").distinct(), "hadm_id", "left_semi").unionByName(missing)
    return read.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"), F.min("hadm_id").alias("first_hadm"))


@query("csv_round_trip", sql(E, [], f"SELECT vec_id, subject_id, CAST(len(embedding) AS INT) AS n, {r5('embedding[1]::DOUBLE')} AS first FROM v_image_embeddings"))
def csv_round_trip(spark, sf_dir):
    """Nested columns go out as JSON text and come back as vectors."""
    path = new_path(spark, "csv")
    sinks.write_csv(view(spark, sf_dir, "v_image_embeddings").select("vec_id", "subject_id", "embedding"), path)
    back = spark.read.schema("vec_id long, subject_id long, embedding string").csv(path, header=True, escape='"')
    parsed = F.from_json("embedding", "array<double>")
    return back.select("vec_id", "subject_id", F.size(parsed).alias("n"), round_to(parsed[0], 5).alias("first"))


@query("dictionary_tables", """SELECT 'nation' AS name, count(*) AS n, FALSE AS missing FROM nation UNION ALL SELECT 'region', count(*), FALSE FROM region UNION ALL SELECT 'none', 0, TRUE""")
def dictionary_tables(spark, sf_dir):
    """Whole dictionary tables; the one that is not there is reported instead of failing the rest. Counts go through the metrics writer."""
    path = sf_dir.rstrip("/")
    found, failed = tables.read_dictionaries(spark, {n: f"{path}/{n}.parquet" for n in ("nation", "region", "none")})
    counts = None
    for name, df in found.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.lit(False).alias("missing"))
        counts = one if counts is None else counts.unionByName(one)
    for name in failed:
        counts = counts.unionByName(spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("missing")))
    out = new_path(spark, "metrics")
    sinks.write_metrics(counts, out)
    return spark.read.schema(counts.schema).json(out)
