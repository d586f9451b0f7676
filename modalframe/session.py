"""Session construction and the one way this package cuts lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def get_spark(app_name: str = "modalframe", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; `conf` keys use `__` for `.` and win over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: `spark.checkpoint.dir`, or where it is unset a folder of the warehouse.

    Both are places that every executor reaches; nothing here depends on the kind of master.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once as a table in the shared folder and return a scan of it.

    The scan survives executor loss, carries real size statistics for the next plan, and keeps column pruning,
    which a cached or checkpointed plan does not.
    """
    return materialize_at(df, name)[0]


def materialize_at(df: DataFrame, name: str = "stage") -> tuple[DataFrame, str]:
    """As `materialize`, and where the table lies."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder."""
    return f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """`path` with the scheme of the file system that Spark would use for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """For jobs run inside: a chain of projections whose generated method is over 8,000 bytes, which the JVM would interpret row by row and never
    compile, is evaluated operator by operator instead. Results are the same."""
    setting = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before), 8000)))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def small_table(df: DataFrame, max_rows: int) -> DataFrame:
    """A relation known to hold at most `max_rows` rows (one per pattern, say), evaluated once and held in the plan.

    More rows than promised is an error, so nothing that grows with the data can pass through the driver here.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"expected at most {max_rows} rows")
    return df.sparkSession.createDataFrame(rows, df.schema)
