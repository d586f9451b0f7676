"""Deterministic stratified train/val/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_key
from ..functions.patterns import COMPLETE
from ..session import small_table
from .ordered import hash_bucket, null_safe_join, rows_at_ranks

TEST_SHARE = 0.2
VAL_SHARE = 0.15
DEFAULT_SEED = 42


def stratum_of(mortality: str, readmission: str, pattern_code: str) -> Column:
    """4 * mortality + 2 * readmission + [all modalities present]: eight strata, and NULL where a label is missing."""
    complete = (F.col(pattern_code) == COMPLETE).cast("int")
    return (F.col(mortality).cast("int") * 4 + F.col(readmission).cast("int") * 2 + complete).cast("int")


def assign_split(
    df: DataFrame, stratum: Column, ident: str = "subject_id", test: float = TEST_SHARE, val: float = VAL_SHARE, seed: int = DEFAULT_SEED,
    few_strata: int | None = None,
) -> DataFrame:
    """Add `split`. Within a stratum of n rows, ordered by md5(id:seed), the first round(test*n) are test, the next
    round(val*rest) val, the others train.

    Only the two boundary hashes per stratum are looked up; the rows themselves are labelled by comparison, so the
    data is never sorted or shuffled for it. A NULL stratum is a stratum of its own. With `few_strata`, a bound on their
    number, the boundaries are found at once and held in the plan, so later passes over the result do not repeat the search.
    """
    keyed = df.withColumn("_s", stratum).withColumn("_h", hash_key(ident, seed))
    n = F.col("n")
    n_test = F.round(n * F.lit(float(test)))
    n_val = F.round((n - n_test) * F.lit(float(val)))
    slim = keyed.select("_s", "_h", F.col(ident).alias("_id"))
    cuts = rows_at_ranks(slim, ["_s"], ["_h", "_id"], hash_bucket("_h"), {"test": n_test, "val": n_test + n_val})
    edge = F.struct("_h", "_id")
    per_stratum = cuts.groupBy("_s").agg(*[F.max(F.when(F.col("tag") == t, edge)).alias(f"_{t}") for t in ("test", "val")])
    if few_strata is not None:
        per_stratum = small_table(per_stratum, few_strata)
    joined = null_safe_join(keyed, per_stratum, ["_s"], "left")
    here = F.struct(F.col("_h").alias("_h"), F.col(ident).alias("_id"))
    split = F.when(here <= F.col("_test"), "test").when(here <= F.col("_val"), "val").otherwise("train")
    return joined.select(*df.columns, split.alias("split"))


def split_balance(df: DataFrame, mortality: str, readmission: str, icu: str, pattern_code: str) -> DataFrame:
    """Rows, label rates and complete-data rate per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(mortality).alias("mortality_rate"),
        F.avg(readmission).alias("readmission_rate"),
        F.avg(icu).alias("icu_rate"),
        F.avg((F.col(pattern_code) == COMPLETE).cast("int")).alias("complete_rate"),
    )
