"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    csv_ready(df).write.mode(mode).csv(path, header=True, escape='"')


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small metrics relation as JSON lines."""
    df.coalesce(1).write.mode(mode).json(path)
