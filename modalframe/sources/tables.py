"""Table and CSV readers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import FLAGS
from ..operators.cohort import restrict_to_subjects
from ..session import materialize

CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for any file system Spark can read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(
    spark: SparkSession, source: str, subjects: DataFrame | None = None, limit: int | None = None, spread_by: str | None = None
) -> DataFrame:
    """A parquet folder (a path) or catalog table (a name), optionally restricted to subjects and limited."""
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    if subjects is not None:
        return restrict_to_subjects(df, subjects, limit, spread_by)
    return df.limit(limit) if limit else df


def read_dictionaries(spark: SparkSession, sources: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Whole dictionary tables; one that cannot be read is reported in the second result and skipped."""
    found, failed = {}, {}
    for name, source in sources.items():
        try:
            found[name] = read_table(spark, source)
        except PySparkException as e:
            failed[name] = str(e).splitlines()[0]
    return found, failed


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """CSV with header and a given schema; empty cells are NULL."""
    formats = {"timestampFormat": timestamp_format, "timestampNTZFormat": timestamp_format}
    return spark.read.schema(schema).options(**formats).csv(path, header=True, nullValue="")


def read_csv_tolerant(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines): quoted text with backslash escapes; bad lines are set aside, not fatal.

    The parse result is stored once, so that both outputs come from the same pass.
    """
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    df = spark.read.schema(full).csv(
        path, header=True, quote='"', escape="\\", multiLine=multi_line, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT
    )
    df = materialize(df, "csv")
    return df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), df.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """The stored copy if there is one (whatever `df` says now), else store `df` and read it back."""
    spark = df.sparkSession
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A missing source is an empty relation."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def repair_ids(df: DataFrame, ident: str = "subject_id") -> DataFrame:
    """`tensor(123)` or `123` -> 123."""
    return df.withColumn(ident, F.regexp_extract(F.col(ident).cast("string"), r"(\d+)", 1).try_cast("long"))


def default_flags(df: DataFrame, flags: Sequence[str] = FLAGS) -> DataFrame:
    """All modalities count as present unless all four flags are there; an empty flag cell means absent."""
    if all(f in df.columns for f in flags):
        return df.withColumns({f: F.coalesce(F.col(f).cast("string").try_cast("double").cast("int"), F.lit(0)) for f in flags})
    return df.withColumns({f: F.lit(1) for f in flags})


@dataclass
class PredictionFile:
    """`rows`: usable predictions; `rejected`: `(line, reason)` of all others; `counts`: how many lines there were of each kind."""

    rows: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def read_prediction_file(spark: SparkSession, path: str, ident: str = "subject_id") -> PredictionFile:
    """Saved predictions as CSV or parquet, with ids repaired and flags defaulted.

    Lines with a wrong number of fields or an unreadable number, and rows whose id holds no number, are set aside with the reason. The file is parsed
    once; both results and the counts come from the stored parse.
    """
    if path.rstrip("/").endswith(".csv"):
        names = spark.read.csv(path, header=True).columns
        kinds = [T.DoubleType() if n.endswith(("_prediction", "_target")) else T.StringType() for n in names]
        schema = T.StructType([*(T.StructField(n, k) for n, k in zip(names, kinds)), T.StructField(CORRUPT, T.StringType())])
        raw = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    else:
        raw = spark.read.parquet(path)
        names = raw.columns
        raw = raw.withColumn(CORRUPT, F.lit(None).cast("string"))
    line = F.coalesce(F.col(CORRUPT), F.to_json(F.struct(*(F.col(f"`{n}`") for n in names))))
    repaired = repair_ids(raw.withColumn("_line", line), ident)
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed line").when(F.col(ident).isNull(), "no id")
    marked = repaired.withColumn("_reason", reason)
    stored = materialize(marked.withColumn("_line", F.when(F.col("_reason").isNotNull(), F.col("_line"))), "predictions")
    # of the stored reasons alone; an observation on the way would tie the session, which does not serialise, to later plans
    kinds = {"malformed": "malformed line", "no_id": "no id"}
    counts = stored.agg(F.count(F.lit(1)).alias("lines"), *(F.count_if(F.col("_reason") == r).alias(k) for k, r in kinds.items())).first().asDict()
    rows = default_flags(stored.filter(F.col("_reason").isNull()).drop("_reason", "_line", CORRUPT))
    rejected = stored.filter(F.col("_reason").isNotNull()).select(F.col("_line").alias("line"), F.col("_reason").alias("reason"))
    return PredictionFile(rows, rejected, counts)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The usable rows of `read_prediction_file`."""
    return read_prediction_file(spark, path).rows
