"""Snapshots of several tables laid out by one key, so that joins and aggregations on it need no exchange."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, new_path, qualified, small_table
from .tables import path_exists

HOT_FACTOR = 2.0
BUCKET_ROWS = 2_000_000  # rows of all tables together that a task is given to sort


@dataclass
class KeyedTables:
    """`tables` are bucketed and sorted by `key`; `hot` holds the rows of the keys that are too large for one bucket, in the ordinary layout.

    Both have the same table names, and no key is in both. `hot` is empty where no key is that large.
    """

    key: str
    buckets: int
    tables: dict[str, DataFrame]
    hot: dict[str, DataFrame]

    def table(self, name: str) -> DataFrame:
        """All rows of one table."""
        return self.tables[name].unionByName(self.hot[name]) if self.hot else self.tables[name]


def _name(path: str) -> str:
    return f"keyed_{hashlib.md5(path.encode()).hexdigest()}"


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _open(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """The table at `path` with its layout known to the planner; the catalog of a new session learns it here."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_name(path)} ({_columns(schema)}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(_name(path))


def write_bucketed(df: DataFrame, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store `df` as one sorted file per bucket of `key` and return the bucketed scan."""
    spark = df.sparkSession
    path = qualified(spark, path or new_path(spark, "bucketed"))
    df.repartition(buckets, key).sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("errorifexists").saveAsTable(_name(path))
    return spark.table(_name(path))


def key_counts(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """`(key, n)`: rows of every key over all tables together."""
    parts = [df.groupBy(F.col(key).alias(key)).agg(F.count(F.lit(1)).alias("n")) for df in tables.values()]
    return reduce(DataFrame.unionAll, parts).groupBy(key).agg(F.sum("n").alias("n"))


def buckets_for(rows: int, buckets: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """The wanted number of buckets, or the multiple of it that keeps `rows` of all tables to about `bucket_rows` a bucket."""
    return buckets * max(1, -(-rows // (buckets * bucket_rows)))


def hot_keys(tables: dict[str, DataFrame], key: str, buckets: int, factor: float = HOT_FACTOR, counts: DataFrame | None = None) -> DataFrame:
    """The keys (NULL is one) with more than `factor` times the mean rows of a bucket, over all tables together: fewer than `buckets / factor` keys."""
    counts = key_counts(tables, key) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    return small_table(counts.filter(F.col("n") > factor * total / buckets).select(key), int(buckets / factor) + 1)


def write_keyed(tables: dict[str, DataFrame], path: str, key: str, buckets: int, factor: float = HOT_FACTOR, bucket_rows: int = BUCKET_ROWS) -> None:
    """Store all `tables` under `path`, unless a complete snapshot lies there.

    A bucket is read by one task: `buckets` is the least number of them, with more than `bucket_rows` rows a bucket there are as many times
    more as it takes (the layout tells how many). Rows of hot keys go to a part of their
    own in the ordinary layout. The layout is written last: without it nothing can be opened, so a broken-off write is never read. Such a
    rest is not overwritten; write to a new path.
    """
    root = path.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    if path_exists(spark, f"{root}/layout/_SUCCESS"):
        return
    counts = materialize(key_counts(tables, key), "key_counts")
    buckets = buckets_for(counts.agg(F.sum("n")).first()[0] or 0, buckets, bucket_rows)
    hot = hot_keys(tables, key, buckets, factor, counts)
    some_hot = not hot.isEmpty()
    wanted = F.broadcast(hot.select(F.col(key).alias("_hot")))  # fewer than buckets / factor rows
    for name, df in tables.items():
        is_hot = df[key].eqNullSafe(F.col("_hot"))
        write_bucketed(df.join(wanted, is_hot, "left_anti") if some_hot else df, key, buckets, f"{root}/{name}")
        if some_hot:
            df.join(wanted, is_hot, "left_semi").write.parquet(f"{root}/hot/{name}")
    rows = [(name, key, buckets, some_hot, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, "name string, key string, buckets int, hot boolean, schema string").coalesce(1).write.json(f"{root}/layout")


def open_keyed(spark: SparkSession, path: str) -> KeyedTables:
    """The snapshot written by `write_keyed`, from any session that reaches `path`."""
    root = path.rstrip("/")
    layout = spark.read.schema("name string, key string, buckets int, hot boolean, schema string").json(f"{root}/layout").collect()  # a row a table
    tables, hot = {}, {}
    for r in layout:
        schema = T.StructType.fromJson(json.loads(r["schema"]))
        tables[r["name"]] = _open(spark, qualified(spark, f"{root}/{r['name']}"), schema, r["key"], r["buckets"])
        if r["hot"]:
            hot[r["name"]] = spark.read.schema(schema).parquet(f"{root}/hot/{r['name']}")
    return KeyedTables(layout[0]["key"], layout[0]["buckets"], tables, hot)
