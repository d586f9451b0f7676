"""What the corpus operators share: table access, stored stages, tokens, folds and connected components."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`. Where the setting is absent (tests, one machine) the warehouse serves."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back: cuts lineage and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or a longer one that no column of `df` has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | None) -> list[bytes]:
    """UTF-8 words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z only: on bytes, lower() and split() do exactly that."""
    return text.encode().lower().split() if text else []


def crc_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod `modulus`; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus


def crc_fold_of(doc_id, modulus: int) -> int:
    return zlib.crc32(b"" if doc_id is None or pd.isna(doc_id) else str(int(doc_id)).encode()) % modulus


def bounded_rows(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most `n` rows of `df`, those with the smallest hash of `key`: repeatable, and independent of row order and layout."""
    return df.orderBy(F.xxhash64(key), key).limit(n)


class UnionFind:
    """Disjoint sets over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True


def _forest(batches, a: str, b: str, chunk: int):
    """Replace the edges of a task by a spanning star forest towards smallest members, at most `chunk` edges at a time."""

    def reduce(frames):
        left = np.concatenate([f[a].to_numpy() for f in frames])
        right = np.concatenate([f[b].to_numpy() for f in frames])
        nodes, code = np.unique(np.concatenate([left, right]), return_inverse=True)
        sets = UnionFind(len(nodes))
        for i, j in zip(code[: len(left)].tolist(), code[len(left) :].tolist()):
            sets.union(i, j)
        roots = np.fromiter((sets.find(i) for i in range(len(nodes))), np.int64, len(nodes))
        own = roots != np.arange(len(nodes))
        return pd.DataFrame({"a": nodes[own], "b": nodes[roots[own]]})

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= chunk:
            yield reduce(held)
            held, n = [], 0
    if held:
        yield reduce(held)


def components(edges: DataFrame, a: str, b: str, chunk: int = 1_000_000) -> DataFrame:
    """(node, component): smallest node reachable over undirected `edges` of two long columns; isolated nodes are absent.

    Alternates large-star and small-star steps. Each task first turns its edges into a spanning forest, so a large group
    costs one edge per member, not one per pair. Each round is stored in the shared folder; the driver sees one count and
    one checksum a round. Rounds go on until nothing changes (their number grows with the logarithm of the longest chain).
    """
    spark = edges.sparkSession
    schema = "a long, b long"
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    stars = store(pairs.mapInPandas(lambda it: _forest(it, "a", "b", chunk), schema).distinct(), "edges")
    last = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # every neighbour of a node, and the node, meets the smallest of them
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = store(small.union(small_min.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "stars")
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
