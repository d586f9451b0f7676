"""Running totals, row numbers and order statistics over groups of any size.

A window `partitionBy(group).orderBy(x)` puts a whole group into one task. Here the value axis is first cut into
buckets that respect the order; a window then runs inside each (group, bucket), and the totals of the buckets before
are added. The table of bucket totals has at most groups x buckets rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

DEFAULT_BUCKETS = 256
SKETCH_TASKS = 64
_BUCKET = "_bucket"


def value_splits(df: DataFrame, col: str, n_buckets: int = DEFAULT_BUCKETS) -> list[float]:
    """At most `n_buckets - 1` cut points at about equal row counts. They steer balance only, never results.

    Sketches are merged in two levels: each of `SKETCH_TASKS` tasks merges a share of the map tasks and keeps four points a
    bucket; one task then sees `SKETCH_TASKS` short lists, however many map tasks there were.
    """
    fine = [i / (4 * n_buckets) for i in range(1, 4 * n_buckets)]
    probs = [i / n_buckets for i in range(1, n_buckets)]
    shares = df.select(F.col(col).alias("_v"), F.pmod(F.spark_partition_id(), F.lit(SKETCH_TASKS)).alias("_p"))
    points = shares.groupBy("_p").agg(F.percentile_approx("_v", fine, 8 * n_buckets).alias("q")).select(F.explode("q").alias("_v"))
    row = points.agg(F.percentile_approx("_v", probs, 8 * n_buckets).alias("q")).first()
    return sorted(set(row["q"] or []))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal `keys` where NULL equals NULL; the keys of `left` stay."""
    named = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = same[0] if same else F.lit(True)
    for s in same[1:]:
        condition = condition & s
    return left.join(named, condition, how).drop(*[f"_k_{k}" for k in keys])


def bucket_of_cuts(value: Column, cuts: Column, max_cuts: int) -> Column:
    """Order-preserving bucket number: even between two cut points, odd exactly on one.

    `cuts` is a sorted array of at most `max_cuts` values. A value held by a large share of the rows is a cut point,
    so it has a bucket of its own and can be recognised. The fold is a binary search over the array.
    """
    steps = [1 << k for k in reversed(range(max(1, max_cuts).bit_length()))]
    below = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda pos, step: F.when(F.get(cuts, pos + step - 1) < value, pos + step).otherwise(pos),
    )
    on_cut = F.coalesce((F.get(cuts, below) == value).cast("int"), F.lit(0))
    return below * 2 + on_cut


def bucket_of(value: Column | str, splits: Sequence[float]) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    if not splits:
        return F.lit(0)
    # one foldable literal instead of hundreds of expression nodes
    cuts = F.split(F.lit(",".join(repr(float(s)) for s in splits)), ",").cast("array<double>")
    return bucket_of_cuts(value, cuts, len(splits))


def ordered_bucket(
    df: DataFrame, order: Sequence[str], n_buckets: int = DEFAULT_BUCKETS, splits: Sequence[float] | None = None
) -> Column:
    """Bucket for the order `(first, second)`: rows tied on a frequent first value are spread by the second."""
    first = order[0]
    cuts = list(splits) if splits is not None else value_splits(df, first, n_buckets)
    main = bucket_of(first, cuts)
    if len(order) == 1:
        return main.cast("long")
    tie_cuts = value_splits(df, order[1], max(2, n_buckets // 4))
    spread = F.when(main % 2 == 1, bucket_of(order[1], tie_cuts)).otherwise(F.lit(0))
    return main.cast("long") * F.lit(2 * (len(tie_cuts) + 1)) + spread


def hash_bucket(key: Column | str, hex_digits: int = 3) -> Column:
    """Bucket for rows ordered by a hex hash: its leading digits, already uniform."""
    key = F.col(key) if isinstance(key, str) else key
    return F.substring(key, 1, hex_digits)


def _bucket_totals(rows: DataFrame, group: Sequence[str], sums: dict[str, str]) -> DataFrame:
    totals = rows.groupBy(*group, _BUCKET).agg(*[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()])
    before = W.partitionBy(*group).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    return totals.select(
        *group,
        _BUCKET,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(whole).alias(f"{o}_total") for o in sums],
    )


def running_totals(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str], bucket: Column
) -> DataFrame:
    """Add `{out}_below` (sum of the rows before this one, in `order`) and `{out}_total` for each `sums[out] = col`.

    `bucket` must not decrease along `order`; `order` must be unique within a group. NULL is a group like any other.
    """
    rows = df.withColumn(_BUCKET, bucket)
    totals = _bucket_totals(rows, group, sums)
    inside = W.partitionBy(*group, _BUCKET).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{o}") for o, c in sums.items()])
    joined = null_safe_join(local, totals, [*group, _BUCKET])
    return joined.select(
        *df.columns,
        *[(F.col(f"_l_{o}") + F.col(f"_b_{o}")).alias(f"{o}_below") for o in sums],
        *[F.col(f"{o}_total") for o in sums],
    )


def row_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], bucket: Column, out: str = "rn") -> DataFrame:
    """`row_number()` per group (from 1) plus the group size as `{out}_total`."""
    ranked = running_totals(df.withColumn("_one", F.lit(1).cast("long")), group, order, {out: "_one"}, bucket)
    return ranked.select(*df.columns, (F.col(f"{out}_below") + 1).alias(out), f"{out}_total")


def rows_at_ranks(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    ranks: dict[str, Column],
    weight: str | None = None,
) -> DataFrame:
    """Exact order statistics: the row standing at each wanted rank of each group.

    `ranks[tag]` is an expression over `n` (the group's row count) that gives a rank from 1. Only the buckets that
    hold a wanted rank are sorted. Returns group columns, `tag`, `n` and the order columns: groups x tags rows.
    """
    rows = df.withColumn(_BUCKET, bucket).withColumn(
        "_w", F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    )
    totals = _bucket_totals(rows, group, {"w": "_w"}).withColumnRenamed("w_total", "n")
    inside = W.partitionBy(*group).orderBy(_BUCKET).rowsBetween(1, 1)
    upto = F.coalesce(F.max("_b_w").over(inside), F.col("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), k.cast("long").alias("k")) for t, k in ranks.items()]))
    targets = (
        totals.withColumn("_upto", upto)
        .select(*group, _BUCKET, "_b_w", "_upto", "n", wanted.alias("_want"))
        .filter((F.col("_want.k") > F.col("_b_w")) & (F.col("_want.k") <= F.col("_upto")))
        .select(*group, _BUCKET, "_b_w", "n", F.col("_want.tag").alias("tag"), F.col("_want.k").alias("_k"))
    )
    # targets holds one row per (group, tag); how many groups there are is the caller's affair, so there is no hint
    cand = null_safe_join(rows.select(*group, _BUCKET, *order, "_w"), targets, [*group, _BUCKET])
    local = W.partitionBy(*group, _BUCKET, "tag").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    pos = F.col("_b_w") + F.sum("_w").over(local)
    return (
        cand.withColumn("_pos", pos)
        .filter((F.col("_k") <= F.col("_pos")) & (F.col("_k") > F.col("_pos") - F.col("_w")))
        .select(*group, "tag", "n", *order)
    )
