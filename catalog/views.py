"""Surrogate views (see FIXTURES.md section 3): one SQL text per view, shared by Spark and DuckDB.

`{name}` marks another relation; `@DAYS(x)` is the one dialect difference.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("customer", "orders", "lineitem", "documents", "embeddings", "events")

VIEWS = {
    "v_patients": """
SELECT c_custkey AS subject_id,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 7 <= 3 THEN 'F' ELSE 'M' END AS gender,
       CAST(18 + c_custkey % 70 AS INT) AS anchor_age,
       CASE c_custkey % 5 WHEN 0 THEN '2008 - 2010' WHEN 1 THEN '2011 - 2013' WHEN 2 THEN '2014 - 2016'
            WHEN 3 THEN '2017 - 2019' ELSE '2020 - 2022' END AS anchor_year_group
FROM {customer}
""",
    "v_admissions": """
SELECT o_custkey AS subject_id, o_orderkey AS hadm_id, o_orderdate AS admittime,
       o_orderdate + @DAYS(CAST(o_orderkey % 10 + 1 AS INT)) AS dischtime,
       CASE WHEN o_orderkey % 20 = 0 THEN o_orderdate + @DAYS(CAST(o_orderkey % 10 + 1 AS INT)) END AS deathtime,
       o_orderpriority AS admission_type,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS insurance,
       CASE o_orderkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS race,
       o_orderstatus AS admission_location,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS discharge_location,
       CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag
FROM {orders}
""",
    "v_detail": """
SELECT o.o_custkey AS subject_id, o.o_orderkey AS hadm_id, l.*
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
""",
    "v_diagnoses_icd": """
SELECT subject_id, hadm_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_partkey % 200 AS STRING) END AS icd_code FROM {v_detail}
""",
    "v_procedures_icd": """
SELECT subject_id, hadm_id, CAST(l_suppkey AS STRING) AS icd_code FROM {v_detail} WHERE l_linestatus = 'O'
""",
    "v_drgcodes": """
SELECT subject_id, hadm_id, CAST(l_partkey % 50 AS STRING) AS drg_code,
       CASE WHEN l_linenumber = 2 AND l_partkey % 3 = 0 THEN NULL ELSE CAST(1 + l_partkey % 4 AS DOUBLE) END AS drg_severity
FROM {v_detail} WHERE l_linenumber <= 3
""",
    "v_labevents": """
SELECT subject_id, CASE WHEN l_linenumber = 6 THEN NULL ELSE hadm_id END AS hadm_id, l_orderkey * 10 + l_linenumber AS labevent_id,
       CASE l_returnflag WHEN 'R' THEN 'abnormal' WHEN 'N' THEN 'NORMAL' ELSE NULL END AS flag FROM {v_detail}
""",
    "v_microbiologyevents": """
SELECT subject_id, hadm_id, l_partkey AS microevent_id,
       CASE l_partkey % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN NULL ELSE 'S' END AS interpretation
FROM {v_detail} WHERE l_returnflag = 'N'
""",
    "v_prescriptions": """
SELECT subject_id, hadm_id, CAST(l_partkey AS STRING) AS poe_id,
       CASE l_partkey % 5 WHEN 0 THEN 'ANTIBIOTIC IV' WHEN 1 THEN 'antibiotic' WHEN 2 THEN NULL ELSE 'MAIN' END AS drug_type
FROM {v_detail} WHERE l_linestatus = 'F'
""",
    "v_emar": """
SELECT subject_id, hadm_id, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_suppkey AS STRING) END AS poe_id,
       CASE WHEN l_partkey % 6 = 0 THEN 'Given ANTIBIOTIC' ELSE 'Given' END AS event_txt
FROM {v_detail} WHERE l_linestatus = 'O'
""",
    "v_services": """
SELECT subject_id, hadm_id, l_shipdate AS transfertime, l_returnflag || l_linestatus AS curr_service FROM {v_detail}
""",
    "v_transfers": """
SELECT subject_id, hadm_id, CASE WHEN l_linenumber = 4 THEN NULL ELSE l_linenumber END AS transfer_id FROM {v_detail}
""",
    "v_icustays": """
SELECT subject_id, hadm_id, l_orderkey AS stay_id, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_quantity / 10.0 END AS los
FROM {v_detail} WHERE l_linenumber = 1 AND l_partkey % 4 = 0
""",
    "v_chartevents": """
SELECT subject_id, hadm_id, l_suppkey AS stay_id FROM {v_detail}
""",
    "v_datetimeevents": """
SELECT subject_id, hadm_id, l_partkey AS itemid FROM {v_detail} WHERE l_linenumber % 2 = 0
""",
    "v_inputevents": """
SELECT subject_id, hadm_id, l_extendedprice AS totalamount FROM {v_detail} WHERE l_returnflag = 'A'
""",
    "v_outputevents": """
SELECT subject_id, hadm_id, l_quantity AS value FROM {v_detail} WHERE l_returnflag = 'R'
""",
    "v_notes": """
SELECT doc_id AS note_id, doc_id % 150 AS subject_id,
       CASE WHEN doc_id % 3 = 0 THEN 'radiology' ELSE 'discharge' END AS note_type,
       CASE WHEN doc_id % 37 = 0 THEN '   '
            WHEN doc_id % 41 = 0 THEN NULL
            WHEN doc_id % 10 = 0 THEN '[Report De-Identified x1] ' || text
            WHEN doc_id % 11 = 0 THEN '**NAME** a.b.c ' || text
            WHEN doc_id % 13 = 0 THEN text || ' end..... ok ----- '
            ELSE text END AS text
FROM {documents}
""",
    "v_image_embeddings": """
SELECT vec_id, vec_id % 120 AS subject_id, CAST(floor(vec_id / 3) AS BIGINT) AS study_id, embedding FROM {embeddings}
""",
    "v_predictions": """
SELECT k AS subject_id, p1 AS readmission_prediction,
       CASE WHEN z1 < 0.25 + 0.5 * p1 + 0.10 * (1 - has_img) - 0.08 * (1 - has_text) THEN 1 ELSE 0 END AS readmission_target,
       p2 AS icu_prediction,
       CASE WHEN z2 < 0.15 + 0.6 * p2 - 0.06 * (1 - has_img) + 0.05 * (1 - has_text) THEN 1 ELSE 0 END AS icu_target,
       p3 AS mortality_prediction,
       CASE WHEN z3 < 0.05 + 0.3 * p3 THEN 1 ELSE 0 END AS mortality_target,
       has_struct, has_img, has_text, has_rad
FROM (SELECT k, CAST(t % 997 AS DOUBLE) / 997 AS p1, CAST(CAST(floor(t / 997) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS z1,
             CAST(CAST(floor(t / 7) AS BIGINT) % 991 AS DOUBLE) / 991 AS p2, CAST(CAST(floor(t / 6937) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS z2,
             CAST(CAST(floor(t / 13) AS BIGINT) % 983 AS DOUBLE) / 983 AS p3, CAST(CAST(floor(t / 12779) AS BIGINT) % 500 AS DOUBLE) / 500 AS z3,
             1 AS has_struct, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS has_img,
             CASE WHEN k % 5 <> 0 THEN 1 ELSE 0 END AS has_text, CASE WHEN k % 199 = 0 THEN 1 ELSE 0 END AS has_rad
      FROM (SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS t FROM {orders}) a) b
""",
    "v_odd_predictions": """
SELECT subject_id,
       CASE WHEN has_rad = 1 THEN CAST('NaN' AS DOUBLE) WHEN readmission_prediction < 0.02 THEN CAST('Infinity' AS DOUBLE)
            WHEN readmission_prediction < 0.04 THEN readmission_prediction - 1 WHEN readmission_prediction > 0.98 THEN readmission_prediction + 1
            WHEN icu_prediction > 0.99 THEN NULL ELSE readmission_prediction END AS score,
       CASE WHEN icu_prediction < 0.02 THEN NULL WHEN icu_prediction < 0.04 THEN CAST(0.5 AS DOUBLE) WHEN icu_prediction < 0.06 THEN CAST(1.5 AS DOUBLE)
            WHEN icu_prediction > 0.98 THEN CAST(-3 AS DOUBLE) ELSE CAST(readmission_target AS DOUBLE) END AS label
FROM {v_predictions}
""",
    "v_epoch_metrics": """
SELECT run, epoch, task, 0.6 + 0.35 * CAST(s % 1000 AS DOUBLE) / 1000 AS auc
FROM (SELECT user_id % 5 AS run, extract(day FROM ts) AS epoch,
             CASE event_type WHEN 'click' THEN 'readmission' WHEN 'view' THEN 'icu' ELSE 'mortality' END AS task,
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS s
      FROM {events} WHERE event_type IN ('click', 'view', 'purchase')
      GROUP BY user_id % 5, extract(day FROM ts),
               CASE event_type WHEN 'click' THEN 'readmission' WHEN 'view' THEN 'icu' ELSE 'mortality' END) e
""",
}


def dependencies(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@lru_cache(maxsize=256)
def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame (base tables pass through)."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sql = VIEWS[name].replace("@DAYS", "make_dt_interval")
    return spark.sql(sql, **{d: view(spark, sf_dir, d) for d in dependencies(sql)})


def view_over(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """The view with the `given` relations in the place of those it reads."""
    sql = VIEWS[name].replace("@DAYS", "make_dt_interval")
    return spark.sql(sql, **{d: given[d] if d in given else view(spark, sf_dir, d) for d in dependencies(sql)})


def views_of(spark: SparkSession, names: Sequence[str], source: str, rows: DataFrame) -> dict[str, DataFrame]:
    """The named views with `rows` in the place of the relation `source`, the only one they read."""
    return {n: spark.sql(VIEWS[n].replace("@DAYS", "make_dt_interval"), **{source: rows}) for n in names}


def columns_used(names: Sequence[str], columns: Sequence[str]) -> list[str]:
    """Those of `columns` that the texts of the named views mention."""
    words = {w for n in names for w in re.findall(r"\w+", VIEWS[n])}
    return [c for c in columns if c in words]


def with_views(*names: str) -> str:
    """DuckDB CTE list (without the WITH keyword) that defines the named views and what they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name not in VIEWS:
            return
        sql = VIEWS[name].replace("@DAYS", "to_days")
        deps = dependencies(sql)
        for dep in deps:
            add(dep)
        done[name] = sql.format(**{d: d for d in deps}).strip()

    for name in names:
        add(name)
    return ",\n".join(f"{n} AS ({s})" for n, s in done.items())
