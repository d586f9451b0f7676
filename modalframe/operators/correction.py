"""Pattern-wise correction of saved predictions: reference choice, fitting, gated blending, iteration, ensembles.

Rows stay distributed; everything that decides about them is a table with one row per missing-modality pattern (at
most 16), joined back by broadcast. Each iteration is written once and read by the next; a run can be taken up where it stopped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clip, finite
from ..functions.patterns import FLAGS, pattern_string
from ..session import new_path, small_methods, small_table
from ..sources.tables import path_exists
from . import rectifier
from .metrics import auc_with_overall, compare_metrics, ranking_metrics, stack_scores
from .ordered import value_splits

# Row thresholds, reference score, strengths, blend weights and ensemble mixes
MAX_PATTERNS = 16
MIN_ROWS, MIN_FIT_ROWS, MIN_REFERENCE_ROWS = 10, 20, 60
REFERENCE_SCORE = {"auc": 0.6, "size": 0.3, "completeness": 0.1}
RELIABLE_ROWS, CAPPED_AUC, MIN_COMPLETENESS = 200, 0.9, 0.25
STRENGTH = {
    "readmission": (0.9, (0.25, 0.35, 0.35, 0.25), {"1001": 1.5, "1000": 1.3, "1111": 0.5, "1011": 1.2, "1010": 0.7}),
    "icu": (1.0, (0.30, 0.40, 0.35, 0.30), {"1001": 1.8, "1000": 1.6, "1111": 0.7, "1011": 1.5, "1101": 1.7}),
    "other": (0.9, (0.25, 0.35, 0.35, 0.25), {}),
}
ICU_BOOST = 1.5
MAX_ITERATIONS, RATE_DECAY, ROLLBACK_SHARE = 5, 0.85, 0.999
READM_BLEND = {"better": 0.9, "close": 0.3, "worse": 0.1}
NEGATIVE_TOLERANCE = 0.005
EXTRA_WEIGHT = 0.3
ICU_ENSEMBLE = {"primary": 0.5, "mild": 0.2, "strong": 0.2, "errors": 0.1}
ICU_MILD, ICU_STRONG, ICU_ERROR_SHIFT = 0.4 * 0.5, 1.5 * 0.7, 0.2
READM_ENSEMBLE = {"primary": 0.6, "mild": 0.15, "strong": 0.15, "rank": 0.1}
READM_MILD, READM_STRONG = 0.5 * 0.4, 1.3 * 0.6

_PARAM_SCHEMA = T.StructType(
    [
        T.StructField("pattern", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in ("d_readm", "d_icu", "vd_icu")],
        T.StructField("n", T.LongType()),
        T.StructField("status", T.StringType()),
    ]
)


def prepare(df: DataFrame, ident: str = "subject_id") -> DataFrame:
    """Prediction table -> working table `(id, pattern, y_readm, y_icu, readm0, icu0, readm, icu)`."""
    return df.select(
        F.col(ident).alias("id"),
        pattern_string(FLAGS).alias("pattern"),
        F.col("readmission_target").cast("double").alias("y_readm"),
        F.col("icu_target").cast("double").alias("y_icu"),
        *[finite(f"{t}_prediction").alias(c) for t, s in (("readmission", "readm"), ("icu", "icu")) for c in (f"{s}0", s)],
    )


def score_splits(state: DataFrame) -> list[float]:
    """Balance points shared by all metric calls on this table; corrected scores stay near the originals."""
    both = state.select(F.explode(F.array("readm0", "icu0")).alias("score"))
    return value_splits(both, "score")


def baseline_metrics(state: DataFrame, splits: list[float] | None = None) -> DataFrame:
    """Per pattern with at least 10 rows: `n, readm_auc, readm_apr, icu_auc, icu_apr`."""
    pairs = {"readm": ("readm0", "y_readm"), "icu": ("icu0", "y_icu")}
    m = ranking_metrics(stack_scores(state, pairs, ["pattern"]), ["pattern", "task"], splits=splits)
    cols = [
        F.max(F.when(F.col("task") == t, F.col(k))).alias(f"{t}_{name}")
        for t in pairs for k, name in (("auc", "auc"), ("ap", "apr"))
    ]
    # group sizes count every row of the pattern, usable or not
    sizes = state.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(m.groupBy("pattern").agg(*cols), "pattern", "left").filter(F.col("n") >= MIN_ROWS)


def reference_scores(baseline: DataFrame) -> DataFrame:
    """Adds `completeness` and `score` (NULL for patterns that cannot be the reference)."""
    n = F.col("n").cast("double")
    completeness = F.length(F.translate("pattern", "0", "")) / 4.0
    auc = F.when((F.col("readm_auc") > CAPPED_AUC) & (n < RELIABLE_ROWS), CAPPED_AUC).otherwise(F.col("readm_auc"))
    size = F.least(F.lit(1.0), n / float(RELIABLE_ROWS))
    w = REFERENCE_SCORE
    score = auc * w["auc"] + size * w["size"] + F.col("completeness") * w["completeness"]
    usable = (n >= MIN_REFERENCE_ROWS) & (F.col("completeness") >= MIN_COMPLETENESS) & (score > 0)
    return baseline.withColumn("completeness", completeness).withColumn("score", F.when(usable, score))


def choose_reference(baseline: DataFrame) -> DataFrame:
    """The best-scoring pattern as one row `(pattern, score)`, or none; ties by pattern."""
    scored = reference_scores(baseline).filter(F.col("score").isNotNull())
    return scored.orderBy(F.col("score").desc(), "pattern").limit(1).select("pattern", "score")


def strength(pattern: Column | str, task: str) -> Column:
    """Base factor plus a weight per absent modality, times the pattern's multiplier."""
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    base, weights, multipliers = STRENGTH.get(task, STRENGTH["other"])
    factor = F.lit(base)
    for i, w in enumerate(weights):
        factor = factor + F.when(F.substring(pattern, i + 1, 1) == "0", w).otherwise(0.0)
    boost = F.lit(1.0)
    for p, m in multipliers.items():
        boost = F.when(pattern == p, m).otherwise(boost)
    return factor * boost


def fit_rectifiers(state: DataFrame, reference: DataFrame) -> DataFrame:
    """Rectifiers for tasks readmission and icu: modality `full` for the reference pattern, `pattern_<SITR>` for every
    other pattern with at least 20 rows."""
    ref = reference.select(F.col("pattern").alias("_ref"))  # one row
    sizes = state.groupBy("pattern").agg(F.count(F.lit(1)).alias("_n"))
    names = sizes.join(ref, F.col("pattern") == F.col("_ref"), "left").select(
        "pattern", "_n", F.when(F.col("_ref").isNotNull(), "full").otherwise(F.concat(F.lit("pattern_"), "pattern")).alias("modality")
    )
    names = names.filter((F.col("modality") == "full") | (F.col("_n") >= MIN_FIT_ROWS)).drop("_n")
    pairs = {"readmission": ("readm0", "y_readm"), "icu": ("icu0", "y_icu")}
    rows = stack_scores(state, pairs, ["pattern"]).join(names, "pattern")
    return rectifier.fit(rows, "score", "label")


def pattern_parameters(state: DataFrame, reference: str, params: DataFrame) -> DataFrame:
    """One local row per pattern: both deltas where it may be corrected, and why not otherwise."""
    stored = {(r["task"], r["modality"]): r for r in params.collect()}  # at most 32 rows
    rows = []
    for r in state.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect():  # at most 16 rows
        p, n = r["pattern"], r["n"]
        readm, icu = (stored.get((t, f"pattern_{p}")) for t in ("readmission", "icu"))
        if p == reference:
            status = "reference"
        elif n < MIN_ROWS:
            status = "too_small"
        elif readm is None or icu is None:
            status = "unfitted"
        else:
            status = "corrected"
        on = status == "corrected"
        rows.append((p, readm["delta"] if on else None, icu["delta"] if on else None, icu["var_delta"] if on else None, n, status))
    return state.sparkSession.createDataFrame(rows, _PARAM_SCHEMA)


def icu_deltas(state: DataFrame, params: DataFrame, rate: float) -> DataFrame:
    """`(pattern, shift_icu)`: adaptive delta on the current scores, times learning rate and pattern strength."""
    fitted = params.filter(F.col("status") == "corrected").select(
        "pattern", F.col("d_icu").alias("delta"), F.col("vd_icu").alias("var_delta"), "n", F.col("n").alias("n_initial")
    )
    # only fitted patterns matter; their parameters are at most 16 rows
    rows = state.select("pattern", "icu")
    adaptive = rectifier.transform(rows, fitted, "icu", keys=["pattern"])
    return adaptive.filter(F.col("status") == "ok").select(
        "pattern", (F.col("delta_adj") * rate * strength("pattern", "icu") * ICU_BOOST).alias("shift_icu")
    )


def candidates(state: DataFrame, params: DataFrame, rate: float = 1.0, use_labels: bool = True) -> DataFrame:
    """Adds `d_readm`, `d_icu`, `shift_icu`, `status` and the candidate scores `c_readm`, `c_icu` (NULL = not correctable)."""
    table = params.join(icu_deltas(state, params, rate), "pattern", "left").select("pattern", "d_readm", "d_icu", "shift_icu", "status")
    # a bounded table: without the hint its size is not known, and the rows would be shuffled by their few patterns
    table = F.broadcast(small_table(table, MAX_PATTERNS))
    rows = state.join(table, "pattern", "left")
    on = F.col("status") == "corrected"
    moved = rectifier.rank_aware(F.col("readm"), F.col("d_readm"), F.lit(True))
    rows = rows.withColumn("c_readm", F.when(on, moved)).withColumn("_q", F.col("icu") - F.col("shift_icu"))
    q = F.col("_q")
    rows = rows.withColumn("_q", F.when((q >= 0.45) & (q <= 0.55), q - 0.07 * F.signum(q - 0.5)).otherwise(q))
    if use_labels:
        wrong = F.when((q > 0.8) & (F.col("y_icu") == 0), q - 0.15).when((q < 0.2) & (F.col("y_icu") == 1), q + 0.15)
        rows = rows.withColumn("_q", wrong.otherwise(q))
    return rows.withColumn("c_icu", F.when(on, clip("_q", 0.001, 0.999))).drop("_q")


NOW = {"readm": ("readm", "y_readm"), "icu": ("icu", "y_icu")}
NEW = {"readm": ("c_readm", "y_readm"), "icu": ("c_icu", "y_icu")}
AFTER = NOW | {"icu_ensemble": ("icu_ensemble", "y_icu"), "readm_ensemble": ("readm_ensemble", "y_readm")}
EVERY = "*"  # stands for all patterns together

Metrics = dict[tuple[str, str], tuple[float | None, float | None]]


def pattern_metrics(rows: DataFrame, pairs: dict[str, tuple[str, str]], splits: list[float] | None = None) -> Metrics:
    """(AUC, Brier) by (pattern, entry) and by (`EVERY`, entry): a few numbers for each of at most 16 patterns, from one counting of the scores."""
    stacked = stack_scores(rows, pairs, ["pattern"])
    found = auc_with_overall(stacked, "pattern", "task", value_splits(stacked, "score") if splits is None else splits)
    return {(r["pattern"], r["task"]): (r["auc"], r["brier"]) for r in found.collect()}


def _gain(after: float | None, before: float | None) -> float | None:
    return None if after is None or before is None else after - before


def readm_weight(gain: float | None, selective: bool) -> float | None:
    """Share of the candidate in the blend; None leaves the scores alone."""
    if gain is None or (selective and gain <= 0):
        return None
    return READM_BLEND["better" if gain > 0 else "close" if abs(gain) < NEGATIVE_TOLERANCE else "worse"]


def icu_weight(gain: float | None, brier: float | None, selective: bool) -> float | None:
    brier = brier or 0.0
    if gain is None or (selective and gain <= -0.0005 and brier <= 0.001):
        return None
    if gain > 0:
        return min(0.95, 0.85 + 3.0 * gain)
    return 0.4 if brier > 0 and abs(gain) < NEGATIVE_TOLERANCE else 0.2


def gates(cand: DataFrame, selective: bool, splits: list[float] | None = None, now: Metrics | None = None) -> DataFrame:
    """Per corrected pattern the blend weights `w_readm`, `w_icu` (NULL = leave the scores alone) and what decided.

    `now` are the metrics of the current scores, where they are known already.
    """
    corrected = cand.filter(F.col("status") == "corrected")
    new = pattern_metrics(corrected, NEW, splits)
    now = pattern_metrics(corrected, NOW, splits) if now is None else now
    unknown = (None, None)
    rows = []
    for pattern in sorted({p for p, _ in new} - {EVERY}):
        (readm0, _), (icu0, brier0) = (now.get((pattern, t), unknown) for t in NOW)
        (readm1, _), (icu1, brier1) = (new.get((pattern, t), unknown) for t in NEW)
        readm, icu, brier = _gain(readm1, readm0), _gain(icu1, icu0), _gain(brier0, brier1)
        rows.append((pattern, readm, icu, brier, readm_weight(readm, selective), icu_weight(icu, brier, selective)))
    return cand.sparkSession.createDataFrame(rows, "pattern string, readm_gain double, icu_gain double, icu_brier_gain double, w_readm double, w_icu double")


def blend(cand: DataFrame, gate: DataFrame, use_labels: bool = True) -> DataFrame:
    """New `readm` and `icu` (the blends) plus `icu_ensemble`."""
    rows = cand.join(F.broadcast(gate.select("pattern", "w_readm", "w_icu")), "pattern", "left")  # a row per corrected pattern
    c, w = F.col("c_readm"), F.col("w_readm")
    extra = F.when((c > 0.4) & (c < 0.6), 0.05 * F.signum(c - 0.5))
    if use_labels:
        extra = extra.when((c > 0.7) & (F.col("y_readm") == 0), -0.1).when((c < 0.3) & (F.col("y_readm") == 1), 0.1)
    mixed = w * c + (1.0 - w) * F.col("readm") + EXTRA_WEIGHT * extra.otherwise(0.0)
    readm = F.when(w.isNotNull(), clip(mixed, 0.001, 0.999)).otherwise(F.col("readm"))
    v = F.col("w_icu")
    icu = F.when(v.isNotNull(), v * F.col("c_icu") + (1.0 - v) * F.col("icu")).otherwise(F.col("icu"))
    rows = rows.withColumn("readm", readm).withColumn("icu", icu)
    return rows.withColumn("icu_ensemble", icu_ensemble(use_labels)).drop("w_readm", "w_icu", "c_readm", "c_icu", "shift_icu")


def icu_ensemble(use_labels: bool = True) -> Column:
    """Current icu scores mixed with mild, strong and error-focused corrections of the originals."""
    p0, shift = F.col("icu0"), F.coalesce(F.col("d_icu"), F.lit(0.0))
    errors = p0
    if use_labels:
        wrong_high, wrong_low = (p0 > 0.8) & (F.col("y_icu") == 0), (p0 < 0.2) & (F.col("y_icu") == 1)
        errors = F.when(wrong_high, p0 - ICU_ERROR_SHIFT).when(wrong_low, p0 + ICU_ERROR_SHIFT).otherwise(p0)
    w = ICU_ENSEMBLE
    total = w["primary"] * F.col("icu") + w["mild"] * (p0 - ICU_MILD * shift) + w["strong"] * (p0 - ICU_STRONG * shift) + w["errors"] * errors
    return clip(total, 0.0, 1.0)


def readm_ensemble() -> Column:
    """Current readmission scores mixed with mild, strong and rank-aware corrections of the originals."""
    p0, delta = F.col("readm0"), F.col("d_readm")
    shift = F.coalesce(delta, F.lit(0.0))
    w = READM_ENSEMBLE
    ranked = rectifier.rank_aware(p0, delta, F.lit(True))
    total = w["primary"] * F.col("readm") + w["mild"] * (p0 - READM_MILD * shift) + w["strong"] * (p0 - READM_STRONG * shift) + w["rank"] * ranked
    return clip(total, 0.0, 1.0)


def learning_rate(iteration: int) -> float:
    return 1.0 / (1.0 + iteration * (1.0 - RATE_DECAY))


@dataclass
class Correction:
    """`rows`: result table; `history`: overall AUC per iteration; `reference`: pattern or None; `best_iteration`: 0
    when the ensemble won."""

    rows: DataFrame
    history: list[dict[str, float]] = field(default_factory=list)
    reference: str | None = None
    best_iteration: int = 0
    used_labels: bool = True

    def metrics(self) -> DataFrame:
        """Before/after AUC, average precision and Brier score of the two corrected tasks."""
        before = {"readmission": ("readm_pred_original", "readm_target"), "icu": ("icu_pred_original", "icu_target")}
        after = {"readmission": ("readm_pred_corrected", "readm_target"), "icu": ("icu_pred_corrected", "icu_target")}
        return compare_metrics(self.rows, before, after)


def result_table(state: DataFrame, readm: str, icu: str, status: Column, ident: str) -> DataFrame:
    return state.select(
        F.col("id").alias(ident),
        F.col("y_readm").alias("readm_target"),
        F.col("readm0").alias("readm_pred_original"),
        F.col(readm).alias("readm_pred_corrected"),
        F.col("y_icu").alias("icu_target"),
        F.col("icu0").alias("icu_pred_original"),
        F.col(icu).alias("icu_pred_corrected"),
        status.alias("status"),
    )


def _less(a: float | None, b: float | None) -> bool:
    """a < b where an undefined AUC never wins."""
    return b is not None and (a is None or a < b)


def _note(spark: SparkSession, path: str, make: Callable[[], dict]) -> dict:
    """The note stored at `path`; where there is none, the one `make` returns, stored."""
    if not path_exists(spark, f"{path}/_SUCCESS"):
        text = json.dumps(make())
        spark.createDataFrame([(text,)], "note string").coalesce(1).write.mode("overwrite").text(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _table(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    if not path_exists(spark, f"{path}/_SUCCESS"):
        df = make()
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def correct_predictions(
    df: DataFrame, selective: bool = False, use_labels: bool = True, max_iterations: int = MAX_ITERATIONS, ident: str = "subject_id", folder: str | None = None
) -> Correction:
    """Full correction: fit on the patterns, up to five gated iterations with roll-back, final ensemble.

    `use_labels` (on by default, recorded in the result) lets the nudges read the evaluation labels.

    Every step leaves its table and a note of what was decided in `folder` (by default one of its own in the shared folder). A run that finds them there
    goes on after the last whole step, so a lost driver costs one iteration at most; a folder of other settings is refused. Each iteration is read by
    three jobs: the adaptive deltas, the candidates' metrics by pattern, and the metrics of the blended scores, by pattern and over all, of which the next
    iteration's gates and the final ensemble need no others.
    """
    with small_methods(df.sparkSession):
        return _correct(df, selective, use_labels, max_iterations, ident, folder)


def _correct(df: DataFrame, selective: bool, use_labels: bool, max_iterations: int, ident: str, folder: str | None) -> Correction:
    spark = df.sparkSession
    root = (folder or new_path(spark, "correction")).rstrip("/")
    settings = {"selective": selective, "use_labels": use_labels, "ident": ident}
    # dealt evenly once: every iteration reads it again, and a small input may lie in a single file
    state = _table(spark, f"{root}/scores", lambda: prepare(df, ident).repartition("id"))

    def set_up() -> dict:
        splits = score_splits(state)
        chosen = choose_reference(baseline_metrics(state, splits)).collect()
        if not chosen:
            return settings | {"reference": None}
        reference = chosen[0]["pattern"]
        params = pattern_parameters(state, reference, fit_rectifiers(state, spark.createDataFrame([(reference,)], "pattern string")))
        return settings | {"reference": reference, "splits": splits, "params": [list(r) for r in params.collect()]}

    setup = _note(spark, f"{root}/setup", set_up)
    if {k: setup[k] for k in settings} != settings:
        raise ValueError(f"{root} holds a correction with other settings")
    reference = setup["reference"]
    if reference is None:
        return Correction(result_table(state, "readm", "icu", F.lit("no_reference"), ident), used_labels=use_labels)
    params, splits = spark.createDataFrame([tuple(r) for r in setup["params"]], _PARAM_SCHEMA), setup["splits"]

    tables: list[DataFrame] = []
    history: list[dict[str, float]] = []
    ensembles: list[float | None] = []
    current, now, kept = state, None, 0
    for i in range(max_iterations):

        def step(i=i, current=current, now=now) -> DataFrame:
            cand = candidates(current.select(*state.columns), params, learning_rate(i), use_labels)
            return blend(cand, gates(cand, selective, splits, now), use_labels).withColumn("readm_ensemble", readm_ensemble())

        new = _table(spark, f"{root}/iteration-{i + 1}", step)
        note = _note(spark, f"{root}/metrics-{i + 1}", lambda new=new: {"rows": [[*k, *v] for k, v in pattern_metrics(new, AFTER, splits).items()]})
        found: Metrics = {(p, t): (auc, brier) for p, t, auc, brier in note["rows"]}
        auc = {t: found.get((EVERY, t), (None, None))[0] for t in AFTER}
        if _less(auc["icu"], auc["icu_ensemble"]):
            new, auc["icu"] = new.withColumn("icu", F.col("icu_ensemble")), auc["icu_ensemble"]
            found |= {(p, "icu"): v for (p, t), v in found.items() if t == "icu_ensemble"}
        tables.append(new)
        ensembles.append(auc["readm_ensemble"])
        history.append({"iteration": i + 1, "readm_auc": auc["readm"], "icu_auc": auc["icu"]})
        if i > 0 and _less(auc["readm"], history[i - 1]["readm_auc"] * ROLLBACK_SHARE):
            kept = i - 1
            break
        current, now, kept = new, found, i

    if _less(history[kept]["readm_auc"], ensembles[kept]):
        return Correction(result_table(tables[kept], "readm_ensemble", "icu", F.col("status"), ident), history, reference, 0, use_labels)
    best = max(range(len(history)), key=lambda k: (history[k]["readm_auc"] or 0.0, -k))
    return Correction(result_table(tables[best], "readm", "icu", F.col("status"), ident), history, reference, best + 1, use_labels)
