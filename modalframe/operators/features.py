"""Detail-table aggregates restricted to the index admission, one-hot coding and the wide join."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import nan_to_null
from ..session import materialize

PAIR = ["subject_id", "hadm_id"]
MAX_CATEGORIES = 10_000

# output column -> (input column, function)
Specs = dict[str, tuple[str, str]]


def _aggregate(col: str, func: str) -> Column:
    if func == "count":
        return F.count(col)
    if func == "size":
        return F.count(F.lit(1))
    if func == "nunique":
        return F.count_distinct(col)
    if func == "sum":
        return F.coalesce(F.sum(col), F.lit(0).cast("double"))
    if func == "sum_flag":
        return F.sum(F.col(col).cast("int"))
    if func == "mode":
        return F.mode(col, deterministic=True)
    if func == "flag":
        return F.max(F.lit(1))
    raise ValueError(f"unknown aggregate {func!r}")


def aggregate_by_admission(detail: DataFrame, specs: Specs) -> DataFrame:
    """Named aggregates per (subject_id, hadm_id)."""
    return detail.groupBy(*PAIR).agg(*[_aggregate(c, f).alias(out) for out, (c, f) in specs.items()])


def aggregate_by_index(detail: DataFrame, pairs: DataFrame, specs: Specs) -> DataFrame:
    """Named aggregates over the rows of each subject's index admission, keyed by (subject_id, hadm_id)."""
    return aggregate_by_admission(at_index(detail, pairs), specs)


def at_index(detail: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """The detail rows of the index admissions. `pairs` has one row per subject; with a filter of its keys pushed to the
    scan, other admissions are not shuffled."""
    return detail if pairs is None else detail.join(pairs.select(*PAIR), PAIR, "left_semi")


class SharedRows(NamedTuple):
    """Detail tables that are all drawn from one relation: `tables(rows)` gives them by name.

    Each row of a table comes from one row of `rows` and has its subject and admission, or NULL in their place. Where `rows` is a join with a relation
    of admissions, `admissions` holds the pairs of that relation, a row for each of its rows, and `joined` makes the rows from these or from fewer.
    """

    rows: DataFrame
    tables: Callable[[DataFrame], dict[str, DataFrame]]
    admissions: DataFrame | None = None
    joined: Callable[[DataFrame], DataFrame] | None = None


def shared_at_index(shared: SharedRows, pairs: DataFrame) -> dict[str, DataFrame]:
    """The detail tables drawn from the shared rows of the index admissions only, which are found and stored once for all tables.

    Rows that are a join with admissions are joined with the index admissions alone. These are stored first, so the join knows how few they are and
    need not move the rows while they can be broadcast.
    """
    if shared.joined:
        return shared.tables(materialize(shared.joined(materialize(at_index(shared.admissions, pairs), "index_admissions")), "index_rows"))
    return shared.tables(materialize(at_index(shared.rows, pairs), "index_rows"))


def label_labs(labs: DataFrame) -> DataFrame:
    return labs.withColumn("abnormal", F.coalesce(F.col("flag"), F.lit("NORMAL")) != "NORMAL")


def label_microbiology(micro: DataFrame) -> DataFrame:
    return micro.withColumn("pos", F.col("interpretation").eqNullSafe("Positive"))


def _doses(rows: DataFrame, kind: str) -> DataFrame:
    found = rows.select(*PAIR, "poe_id", F.col(kind).alias("drug_type"))
    return found.withColumn("abx", F.coalesce(F.col("drug_type").contains("ANTIBIOTIC"), F.lit(False)))


def medications(prescriptions: DataFrame, emar: DataFrame) -> DataFrame:
    """Prescriptions and administrations as one relation with the antibiotic marker."""
    return _doses(prescriptions, "drug_type").unionByName(_doses(emar, "event_txt"))


SPECS: dict[str, Specs] = {
    "diagnoses_icd": {"idx_dx_count": ("icd_code", "count"), "idx_unique_dx": ("icd_code", "nunique")},
    "procedures_icd": {"idx_proc_count": ("icd_code", "count"), "idx_unique_proc": ("icd_code", "nunique")},
    "drgcodes": {"idx_drg_count": ("drg_code", "size"), "idx_severity_mode": ("drg_severity", "mode")},
    "labevents": {"idx_lab_count": ("labevent_id", "count"), "idx_lab_abn": ("abnormal", "sum_flag")},
    "microbiologyevents": {"idx_micro_count": ("microevent_id", "count"), "idx_micro_pos": ("pos", "sum_flag")},
    "medications": {"idx_med_count": ("poe_id", "count"), "idx_med_abx": ("abx", "sum_flag")},
    "services": {"idx_serv_changes": ("transfertime", "count"), "idx_uniq_serv": ("curr_service", "nunique")},
    "transfers": {"idx_trans_count": ("transfer_id", "count")},
    "icustays": {"idx_icu_flag": ("stay_id", "flag"), "idx_icu_los": ("los", "sum")},
    "chartevents": {"idx_char_count": ("stay_id", "count")},
    "datetimeevents": {"idx_dt_count": ("itemid", "count")},
    "inputevents": {"idx_in_vol": ("totalamount", "sum")},
    "outputevents": {"idx_out_vol": ("value", "sum")},
}
DERIVE = {"labevents": label_labs, "microbiologyevents": label_microbiology}


def fluid_balance(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Full outer join of in and out volumes, missing side 0, net = in - out."""
    joined = inputs.join(outputs, PAIR, "full_outer")
    vols = joined.select(
        *PAIR,
        F.coalesce("idx_in_vol", F.lit(0.0)).alias("idx_in_vol"),
        F.coalesce("idx_out_vol", F.lit(0.0)).alias("idx_out_vol"),
    )
    return vols.withColumn("idx_net_fluid", F.col("idx_in_vol") - F.col("idx_out_vol"))


def _ready(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    ready = {k: DERIVE[k](v) if k in DERIVE else v for k, v in tables.items()}
    if "prescriptions" in tables and "emar" in tables:
        ready["medications"] = medications(tables["prescriptions"], tables["emar"])
    return ready


def admission_frames(tables: dict[str, DataFrame], pairs: DataFrame | None = None) -> dict[str, DataFrame]:
    """One frame per detail table present in `tables`, aggregated per (subject_id, hadm_id); in and out volumes become
    `fluids`. With `pairs`, only index admissions."""
    ready = _ready(tables)
    frames = {name: aggregate_by_admission(at_index(ready[name], pairs), specs) for name, specs in SPECS.items() if name in ready}
    if "inputevents" in frames and "outputevents" in frames:
        frames["fluids"] = fluid_balance(frames.pop("inputevents"), frames.pop("outputevents"))
    return frames


def _cells(detail: DataFrame, table: int, specs: Specs) -> DataFrame:
    """The rows of one table reduced to `(pair, table, code, n, flags, amount)`, what its aggregates need."""
    by = {func: col for col, func in specs.values()}
    counted = F.when(F.col(by["count"]).isNotNull(), 1).otherwise(0) if "count" in by else F.lit(1)
    none = F.lit(None)
    return detail.select(
        *PAIR,
        F.lit(table).alias("table"),
        (F.col(by["nunique"]) if "nunique" in by else none).cast("string").alias("code"),
        counted.cast("long").alias("n"),
        (F.col(by["sum_flag"]) if "sum_flag" in by else none).cast("int").cast("long").alias("flags"),
        (F.coalesce(F.col(by["sum"]).cast("double"), F.lit(0.0)) if "sum" in by else none.cast("double")).alias("amount"),
    )


def _with_fluids(frame: DataFrame) -> DataFrame:
    """In, out and net volumes: a missing side is 0, both missing stay NULL."""
    vols = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("idx_in_vol", "idx_out_vol")]
    either = F.col("idx_in_vol").isNotNull() | F.col("idx_out_vol").isNotNull()
    return frame.withColumns(
        {"idx_in_vol": F.when(either, vols[0]), "idx_out_vol": F.when(either, vols[1]), "idx_net_fluid": F.when(either, vols[0] - vols[1])}
    )


def combined_frame(tables: dict[str, DataFrame], pairs: DataFrame | None = None) -> DataFrame:
    """All detail aggregates per (subject_id, hadm_id) in one relation; NULL where a table has no row for the pair.

    With `pairs`, rows of other than the index admissions are left out before anything is aggregated.

    The tables are stacked and aggregated together, so all of them share one exchange on the pair instead of an
    exchange and a join each. Tables with distinct counts are first reduced to their distinct codes; a table that needs
    a mode is aggregated on its own and joined.
    """
    ready = _ready(tables)
    specs = {t: s for t, s in SPECS.items() if t in ready}
    uses = {t: {f for _, f in s.values()} for t, s in specs.items()}
    together = [t for t in specs if "mode" not in uses[t]]
    plain = [_cells(ready[t], i, specs[t]) for i, t in enumerate(together) if "nunique" not in uses[t]]
    coded = [_cells(ready[t], i, specs[t]) for i, t in enumerate(together) if "nunique" in uses[t]]
    if plain:
        plain = [at_index(reduce(DataFrame.unionByName, plain), pairs)]
    if coded:
        by_code = at_index(reduce(DataFrame.unionByName, coded), pairs).groupBy(*PAIR, "table", "code")
        plain.append(by_code.agg(*[F.sum(c).alias(c) for c in ("n", "flags", "amount")]))
    out = None
    if plain:
        value = {
            "count": F.col("n"), "size": F.col("n"), "sum": F.col("amount"), "sum_flag": F.col("flags"),
            "nunique": F.col("code").isNotNull().cast("long"), "flag": F.lit(1),
        }
        out = reduce(DataFrame.unionByName, plain).groupBy(*PAIR).agg(
            *[
                (F.max if f == "flag" else F.sum)(F.when(F.col("table") == i, value[f])).alias(name)
                for i, t in enumerate(together) for name, (_, f) in specs[t].items()
            ]
        )
        if "inputevents" in specs and "outputevents" in specs:
            out = _with_fluids(out)
    for t in specs:
        if t not in together:
            frame = aggregate_by_admission(at_index(ready[t], pairs), specs[t])
            out = frame if out is None else out.join(frame, PAIR, "full_outer")
    order = [name for s in specs.values() for name in s]
    extra = [c for c in out.columns if c not in (*PAIR, *order)]
    return out.select(*PAIR, *order, *extra)


def colocated_frame(tables: dict[str, DataFrame], pairs: DataFrame) -> DataFrame:
    """All detail aggregates, one row per row of `pairs`; NULL where a table has no row for the pair.

    For tables and pairs that are all bucketed by `subject_id` alike: each table meets the pairs, is aggregated and joined where it lies, without an
    exchange. The join key is the subject alone, since a key of both columns would ask for a partitioning by both; the admission
    is compared as a range. `pairs` has one row per subject. Rows of hot subjects do not belong here, see `sources.bucketed`.
    """
    ready = {k: DERIVE[k](v) if k in DERIVE else v for k, v in tables.items()}
    parts = {t: (ready[t], s) for t, s in SPECS.items() if t in ready}
    doses = {"prescriptions": "drug_type", "emar": "event_txt"}
    halves = doses if all(t in tables for t in doses) else {}
    for t, kind in halves.items():
        # the two halves of the medications, each where it lies
        parts[t] = (_doses(tables[t], kind), {f"{name}_{t}": spec for name, spec in SPECS["medications"].items()})
    index = pairs.select(F.col("subject_id").alias("_s"), F.col("hadm_id").alias("_h"))
    out = pairs.select(*PAIR)
    for rows, specs in parts.values():
        at = (F.col("subject_id") == F.col("_s")) & (F.col("hadm_id") <= F.col("_h")) & (F.col("hadm_id") >= F.col("_h"))
        frame = aggregate_by_admission(rows.join(index, at, "left_semi"), specs).drop("hadm_id")
        out = out.join(frame, "subject_id", "left")
    if halves:
        for name in SPECS["medications"]:
            both = [f"{name}_{t}" for t in halves]
            total = F.coalesce(both[0], F.lit(0)) + F.coalesce(both[1], F.lit(0))
            out = out.withColumn(name, F.when(F.coalesce(*both).isNotNull(), total)).drop(*both)
    if "inputevents" in ready and "outputevents" in ready:
        out = _with_fluids(out)
    order = [name for specs in SPECS.values() for name in specs if name in out.columns]
    return out.select(*PAIR, *order, *[c for c in out.columns if c not in (*PAIR, *order)])


def feature_frames(tables: dict[str, DataFrame], pairs: DataFrame) -> dict[str, DataFrame]:
    """The frames of each subject's index admission."""
    return admission_frames(tables, pairs)


def categories_of(df: DataFrame, cols: Sequence[str], max_categories: int = MAX_CATEGORIES) -> dict[str, list[str]]:
    """Sorted distinct non-NULL values of each column, read in one job. They become column names, so more
    than `max_categories` (a parameter; the categories can also be passed to `one_hot`) is an error, never a cut."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols]))
    found = df.select(items.alias("s")).select("s.*").filter(F.col("v").isNotNull()).distinct().limit(max_categories + 1).collect()
    if len(found) > max_categories:
        raise ValueError(f"more than {max_categories} categories in {list(cols)}; one-hot coding is not meaningful")
    return {c: sorted(r["v"] for r in found if r["c"] == c) for c in cols}


def one_hot(df: DataFrame, cols: Sequence[str], categories: dict[str, list[str]] | None = None) -> DataFrame:
    """Replace each column by 0/1 columns `{col}_{value}` in value order plus `{col}_nan` for NULL."""
    categories = categories or categories_of(df, cols)
    out = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    for c in cols:
        value = F.col(c).cast("string")
        out += [F.coalesce((value == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in categories[c]]
        out.append(value.isNull().cast("int").alias(f"{c}_nan"))
    return df.select(*out)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def fill_missing(df: DataFrame, string_fill: str = "", exclude: Sequence[str] = ("subject_id",)) -> DataFrame:
    """NaN -> NULL, then numeric NULL -> 0 and string NULL -> `string_fill`."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in exclude:
            out.append(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.coalesce(nan_to_null(c), F.lit(0.0).cast(f.dataType)).alias(f.name))
        elif is_numeric(f.dataType):
            out.append(F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(c, F.lit(string_fill)).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)
