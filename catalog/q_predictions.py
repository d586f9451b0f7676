"""Metrics, rectifier and loss-free queries over the prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.functions.numeric import normal_quantile, round_to
from modalframe.functions.patterns import pattern_string
from modalframe.operators import metrics as M
from modalframe.operators import rectifier as R

from .registry import query, r6, sql
from .views import view

P = ("v_predictions",)
Z = repr(normal_quantile(0.05))

PP = "pp AS (SELECT *, concat(has_struct, has_img, has_text, has_rad) AS pattern FROM v_predictions)"
PL = """pl AS (
  SELECT 'readmission' AS task, * EXCLUDE (score, label), readmission_prediction AS score, readmission_target AS label FROM (SELECT *, 0 AS score, 0 AS label FROM pp)
  UNION ALL
  SELECT 'icu' AS task, * EXCLUDE (score, label), icu_prediction AS score, icu_target AS label FROM (SELECT *, 0 AS score, 0 AS label FROM pp)
  UNION ALL
  SELECT 'mortality' AS task, * EXCLUDE (score, label), mortality_prediction AS score, mortality_target AS label FROM (SELECT *, 0 AS score, 0 AS label FROM pp))"""


def curve_ctes(source: str, group: str, prefix: str = "c") -> list[str]:
    """`{prefix}1`: one row per (group, score) with positives and negatives at and below it, and totals."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group}" if group else ""
    below = f"OVER ({part} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return [
        f"{prefix}0 AS (SELECT {g}score, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos, "
        f"CAST(sum(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM {source} GROUP BY {g}score)",
        f"{prefix}1 AS (SELECT *, coalesce(sum(pos) {below}, 0)::DOUBLE AS pos_below, coalesce(sum(neg) {below}, 0)::DOUBLE AS neg_below, "
        f"(sum(pos) OVER ({part}))::DOUBLE AS p, (sum(neg) OVER ({part}))::DOUBLE AS n FROM {prefix}0)",
    ]


def metric_ctes(source: str, group: str, prefix: str = "c") -> list[str]:
    """`{prefix}m`: per group n, n_pos, auc, ap, brier (unrounded)."""
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return curve_ctes(source, group, prefix) + [
        f"""{prefix}m AS (SELECT {g}CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos,
  CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_below + neg / 2.0)) / (max(p) * max(n)) END AS auc,
  CASE WHEN sum(pos) > 0 THEN sum(pos * (p - pos_below) / ((p - pos_below) + (n - neg_below))) / max(p) END AS ap,
  sum(pos * (score - 1) * (score - 1) + neg * score * score) / sum(pos + neg) AS brier FROM {prefix}1 {by})"""
    ]


FIT_CTES = [
    """f0 AS (SELECT task, pattern AS modality, count(*) AS n, avg(score - label) AS m, greatest(var_samp(score - label), 1e-4) AS v FROM pl GROUP BY task, pattern)""",
    """f1 AS (SELECT *, CASE WHEN abs(m) > 0.3 THEN sign(m) * 0.3 ELSE m END AS d1 FROM f0)""",
    """f2 AS (SELECT *, CASE WHEN n < 30 THEN d1 * greatest(0.3, n / 30.0::DOUBLE) ELSE d1 END AS d2 FROM f1)""",
    """f3 AS (SELECT *, CASE WHEN v > 0.2 AND abs(d2) > 0.01 AND abs(d2) / sqrt(v) < 0.5
       THEN d2 * least(0.8, greatest(0.2, abs(d2) / sqrt(v))) ELSE d2 END AS d3 FROM f2)""",
    """fit AS (SELECT task, modality, CASE WHEN n >= 10 THEN d3 ELSE 0.0 END::DOUBLE AS delta, CASE WHEN n >= 10 THEN v ELSE 0.0 END::DOUBLE AS var_delta,
       n, CASE WHEN n >= 10 THEN n END AS n_initial FROM f3)""",
]


def transform_ctes(source: str = "pl", fit: str = "fit", score: str = "score", prefix: str = "t", epoch: int | None = None) -> list[str]:
    x = prefix
    ramp = "" if epoch is None else f" * {min(1.0, (epoch - 10) / 20.0) if epoch > 10 else 0.1}"
    return [
        f"""{x}0 AS (SELECT s.task, s.modality, s.theta_tilde, s.n_unlabeled, coalesce(s.v, 0.1) AS var_f, sqrt(coalesce(s.v, 0.1)) AS s,
       f.delta, f.var_delta, f.n, f.n_initial FROM (SELECT task, pattern AS modality, avg({score}) AS theta_tilde, var_samp({score}) AS v,
       count({score}) AS n_unlabeled FROM {source} GROUP BY task, pattern) s LEFT JOIN {fit} f USING (task, modality))""",
        f"{x}1 AS (SELECT *, CASE WHEN s > 0.25 THEN delta * 1.2 * greatest(0.3, 0.7 - (s - 0.25)) ELSE delta * 1.2 END AS a1 FROM {x}0)",
        f"{x}2 AS (SELECT *, CASE WHEN abs(a1 / greatest(0.01, theta_tilde)) > 0.15 THEN 0.15 * theta_tilde * sign(a1) ELSE a1 END AS a2 FROM {x}1)",
        f"{x}3 AS (SELECT *, (CASE WHEN n < n_initial * 0.7 THEN delta * greatest(0.3, n / n_initial::DOUBLE) ELSE a2 END){ramp} AS a3 FROM {x}2)",
        f"{x}4 AS (SELECT *, CASE WHEN s > 0.3 THEN a3 * greatest(0.4, 0.8 - (s - 0.3)) ELSE a3 END AS a4 FROM {x}3)",
        f"{x}5 AS (SELECT *, CASE WHEN abs(a4 / greatest(0.01, theta_tilde)) > 0.2 THEN 0.2 * theta_tilde * sign(a4) ELSE a4 END AS a5 FROM {x}4)",
        f"{x}tr AS (SELECT *, CASE WHEN theta_tilde - a5 < 0 THEN theta_tilde - 0.01 WHEN theta_tilde - a5 > 1 THEN theta_tilde - 0.99 ELSE a5 END AS delta_adj FROM {x}5)",
    ]


def rank_aware_sql(p: str, delta: str, missing: str = "TRUE") -> str:
    q = f"({p} - 0.7::DOUBLE * {delta})"
    mid = f"CASE WHEN abs({q} - 0.5) < 0.05 THEN {q} + 0.07::DOUBLE * sign({q} - 0.5) ELSE {q} - 0.05::DOUBLE * sign({q} - 0.5) END"
    moved = f"CASE WHEN {missing} THEN CASE WHEN {q} >= 0.4::DOUBLE AND {q} <= 0.6::DOUBLE THEN {mid} ELSE {q} END ELSE {p} END"
    return f"CASE WHEN {delta} IS NULL THEN {p} ELSE least(greatest({moved}, 0.0), 1.0) END"


def predictions(spark, sf_dir):
    return view(spark, sf_dir, "v_predictions")


def stacked(spark, sf_dir, keep=()):
    df = predictions(spark, sf_dir).withColumn("pattern", pattern_string())
    return M.stack_tasks(df, ["pattern", *keep])


def gold(spark, sf_dir, keep=()):
    return stacked(spark, sf_dir, keep).withColumnRenamed("pattern", "modality")


def flagship(spark, sf_dir):
    """How biased is each missing-modality group, and what do its corrected scores look like?"""
    rows = gold(spark, sf_dir)
    params = R.fit(rows, "score", "label")
    fixed = R.subtract_delta(rows.withColumn("flag", F.lit(0)), params, "score", "flag")
    keys = ["task", "modality"]
    before = M.ranking_metrics(rows, keys)
    after = fixed.groupBy(*keys).agg(
        F.avg("corrected").alias("mean_corrected"), F.avg(F.pow(F.col("corrected") - F.col("label"), 2)).alias("brier_corrected")
    )
    return (
        before.join(params.drop("n"), keys)
        .join(after, keys)
        .select(
            *keys, "n", "n_pos", round_to("auc").alias("auc"), round_to("ap").alias("ap"), round_to("brier").alias("brier"),
            round_to("delta").alias("delta"), round_to("var_delta").alias("var_delta"),
            round_to("mean_corrected").alias("mean_corrected"), round_to("brier_corrected").alias("brier_corrected"),
        )
    )


query(
    "flagship_bias_by_pattern",
    sql(P, [PP, PL, *metric_ctes("pl", "task, pattern"), *FIT_CTES,
            "af AS (SELECT pl.task, pl.pattern AS modality, avg(score - delta) AS mc, avg((score - delta - label) * (score - delta - label)) AS bc "
            "FROM pl JOIN fit ON pl.task = fit.task AND pl.pattern = fit.modality GROUP BY pl.task, pl.pattern)"],
        f"""SELECT cm.task, cm.pattern AS modality, cm.n, cm.n_pos, {r6('auc')} AS auc, {r6('ap')} AS ap, {r6('brier')} AS brier,
{r6('delta')} AS delta, {r6('var_delta')} AS var_delta, {r6('mc')} AS mean_corrected, {r6('bc')} AS brier_corrected
FROM cm JOIN fit ON cm.task = fit.task AND cm.pattern = fit.modality JOIN af ON cm.task = af.task AND cm.pattern = af.modality"""),
)(flagship)


def _metric(name, column):
    @query(f"{name}_by_pattern", sql(P, [PP, PL, *metric_ctes("pl", "task, pattern")],
                                     f"SELECT task, pattern, n, n_pos, {r6(column)} AS {column} FROM cm"))
    def run(spark, sf_dir):
        measure = M.ranking_metrics if column == "ap" else M.auc_and_brier
        m = measure(stacked(spark, sf_dir), ["task", "pattern"])
        return m.select("task", "pattern", "n", "n_pos", round_to(column).alias(column))


for _n in ("auc", "ap", "brier"):
    _metric(_n, _n)


@query("auc_global", sql(P, [PP, PL, *metric_ctes("pl", "task")],
                         f"SELECT task, n, n_pos, {r6('auc')} AS auc, {r6('ap')} AS ap, {r6('brier')} AS brier FROM cm"))
def auc_global(spark, sf_dir):
    m = M.ranking_metrics(stacked(spark, sf_dir), ["task"])
    return m.select("task", "n", "n_pos", *[round_to(c).alias(c) for c in ("auc", "ap", "brier")])


@query("roc_points", sql(P, [PP, PL, *curve_ctes("pl", "task")], f"""
SELECT task, {r6('(n - neg_below) / n')} AS fpr, {r6('(p - pos_below) / p')} AS tpr, {r6('score')} AS threshold FROM c1
UNION ALL SELECT DISTINCT task, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM c1"""))
def roc_points(spark, sf_dir):
    pts = M.roc_points(stacked(spark, sf_dir), ["task"])
    return pts.select("task", *[round_to(c).alias(c) for c in ("fpr", "tpr", "threshold")])


@query("pr_points", sql(P, [PP, PL, *curve_ctes("pl", "task")], f"""
SELECT task, {r6('(p - pos_below) / p')} AS recall, {r6('(p - pos_below) / (p - pos_below + n - neg_below)')} AS precision, {r6('score')} AS threshold,
 {r6('p / (p + n)')} AS prevalence FROM c1
UNION ALL SELECT DISTINCT task, 0.0::DOUBLE, 1.0::DOUBLE, NULL::DOUBLE, {r6('p / (p + n)')} FROM c1"""))
def pr_points(spark, sf_dir):
    pts = M.pr_points(stacked(spark, sf_dir), ["task"])
    return pts.select("task", *[round_to(c).alias(c) for c in ("recall", "precision", "threshold", "prevalence")])


_SHORT = [(p, t, s) for p, t, s in M.TASKS.values()]


@query("prediction_analysis", sql(P, [PP], "SELECT subject_id, pattern AS missing_pattern, CAST(has_struct + has_img + has_text + has_rad AS INT) AS modality_count, "
    + ", ".join(f"{r6(f'abs({p} - {t})')} AS {s}_abs_error, CAST(({p} >= 0.5) = ({t} = 1) AS INT) AS {s}_correct, {r6(f'abs({p} - 0.5) * 2')} AS {s}_confidence"
                for p, t, s in _SHORT) + " FROM pp"))
def prediction_analysis(spark, sf_dir):
    df = M.prediction_analysis(predictions(spark, sf_dir))
    cols = []
    for _, _, s in _SHORT:
        cols += [round_to(f"{s}_abs_error").alias(f"{s}_abs_error"), f"{s}_correct", round_to(f"{s}_confidence").alias(f"{s}_confidence")]
    return df.select("subject_id", "missing_pattern", "modality_count", *cols)


@query("accuracy_by_modality_count", sql(P, [PP], "SELECT has_struct + has_img + has_text + has_rad AS modality_count, count(*) AS n, "
    + ", ".join(f"{r6(f'avg(CAST(({p} >= 0.5) = ({t} = 1) AS INT))')} AS {s}_accuracy" for p, t, s in _SHORT)
    + " FROM pp GROUP BY ROLLUP (has_struct + has_img + has_text + has_rad)"))
def accuracy_by_modality_count(spark, sf_dir):
    df = M.accuracy_by_modality_count(predictions(spark, sf_dir))
    return df.select("modality_count", "n", *[round_to(f"{s}_accuracy").alias(f"{s}_accuracy") for _, _, s in _SHORT])


@query("rectifier_fit", sql(P, [PP, PL, *FIT_CTES], f"SELECT task, modality, {r6('delta')} AS delta, {r6('var_delta')} AS var_delta, n, n_initial FROM fit"))
def rectifier_fit(spark, sf_dir):
    t = R.fit(gold(spark, sf_dir), "score", "label")
    return t.select("task", "modality", round_to("delta").alias("delta"), round_to("var_delta").alias("var_delta"), "n", "n_initial")


@query("rectifier_listing", sql(P, [PP, PL, *FIT_CTES], f"SELECT task || '_' || modality AS key, {r6('delta')} AS delta, {r6('var_delta')} AS var_delta, n AS n_samples FROM fit"))
def rectifier_listing(spark, sf_dir):
    t = R.all_corrections(R.fit(gold(spark, sf_dir), "score", "label"))
    return t.select("key", round_to("delta").alias("delta"), round_to("var_delta").alias("var_delta"), "n_samples")


_W = "(0.5 + mortality_prediction)"
_WFIT = [
    f"""w0 AS (SELECT task, pattern AS modality, count(*) AS n, sum({_W}) AS sw, sum({_W} * {_W}) AS sww, sum({_W} * (score - label)) AS swe,
       sum({_W} * (score - label) * (score - label)) AS swee FROM pl GROUP BY task, pattern)""",
    "w1 AS (SELECT *, swe / sw AS m, sw * sw / sww AS n_eff FROM w0)",
    "w2 AS (SELECT *, greatest((swee / sw - m * m) * (n_eff / (n_eff - 1)), 1e-4) AS v, CASE WHEN abs(m) > 0.3 THEN sign(m) * 0.3 ELSE m END AS d1 FROM w1)",
    "w3 AS (SELECT *, CASE WHEN floor(n_eff) < 30 THEN d1 * greatest(0.3, floor(n_eff) / 30.0) ELSE d1 END AS d2 FROM w2)",
    "w4 AS (SELECT *, CASE WHEN v > 0.2 AND abs(d2) > 0.01 AND abs(d2) / sqrt(v) < 0.5 THEN d2 * least(0.8, greatest(0.2, abs(d2) / sqrt(v))) ELSE d2 END AS d3 FROM w3)",
]


@query("rectifier_fit_weighted", sql(P, [PP, PL, *_WFIT], f"""SELECT task, modality, {r6('CASE WHEN n >= 10 THEN d3 ELSE 0 END::DOUBLE')} AS delta,
 {r6('CASE WHEN n >= 10 THEN v ELSE 0 END::DOUBLE')} AS var_delta, n, CASE WHEN n >= 10 THEN n END AS n_initial FROM w4"""))
def rectifier_fit_weighted(spark, sf_dir):
    rows = gold(spark, sf_dir, ["mortality_prediction"]).withColumn("w", 0.5 + F.col("mortality_prediction"))
    t = R.fit(rows, "score", "label", weight="w")
    return t.select("task", "modality", round_to("delta").alias("delta"), round_to("var_delta").alias("var_delta"), "n", "n_initial")


_TR = ["theta_rect", "theta_tilde", "var_f", "delta_adj", "var_delta"]


def _tr_sql(epoch):
    cols = ", ".join(f"{r6('theta_tilde - delta_adj' if c == 'theta_rect' else c)} AS {c}" for c in _TR)
    return sql(P, [PP, PL, *FIT_CTES, *transform_ctes(epoch=epoch)], f"SELECT task, modality, {cols}, n_unlabeled FROM ttr")


def _transform(epoch):
    def run(spark, sf_dir):
        rows = gold(spark, sf_dir)
        t = R.transform(rows, R.fit(rows, "score", "label"), "score", epoch=epoch)
        return t.select("task", "modality", *[round_to(c).alias(c) for c in _TR], "n_unlabeled")

    return run


query("rectifier_transform", _tr_sql(None))(_transform(None))
query("rectifier_transform_epoch20", _tr_sql(20))(_transform(20))


_SE = f"{Z} * sqrt(var_delta / n + var_f / n_unlabeled)"


def _guarded(expr):
    return f"CASE WHEN n > 1 AND n_unlabeled > 1 THEN {r6(expr)} END"


@query("rectifier_ci", sql(P, [PP, PL, *FIT_CTES, *transform_ctes()], f"""SELECT task, modality, {_guarded('theta_tilde - delta_adj - ' + _SE)} AS ci_low,
 {_guarded('theta_tilde - delta_adj')} AS ci_center, {_guarded('theta_tilde - delta_adj + ' + _SE)} AS ci_high FROM ttr"""))
def rectifier_ci(spark, sf_dir):
    rows = gold(spark, sf_dir)
    params = R.fit(rows, "score", "label")
    t = R.transform(rows, params, "score").join(params.select("task", "modality", "n"), ["task", "modality"])
    return R.confidence_interval(t).select("task", "modality", *[round_to(c).alias(c) for c in ("ci_low", "ci_center", "ci_high")])


@query("rectifier_apply", sql(P, [PP, PL, *FIT_CTES], f"""SELECT subject_id, pl.task, {r6('CASE WHEN has_img = 0 THEN score - delta ELSE score END')} AS corrected
 FROM pl JOIN fit ON pl.task = fit.task AND pl.pattern = fit.modality"""))
def rectifier_apply(spark, sf_dir):
    rows = gold(spark, sf_dir, ["subject_id", "has_img"])
    fixed = R.subtract_delta(rows, R.fit(rows, "score", "label"), "score", "has_img")
    return fixed.select("subject_id", "task", round_to("corrected").alias("corrected"))


@query("rank_aware", sql(P, [PP, PL, *FIT_CTES], f"""SELECT subject_id, pl.task, {r6(rank_aware_sql('score', 'delta', 'has_img = 0'))} AS corrected
 FROM pl JOIN fit ON pl.task = fit.task AND pl.pattern = fit.modality"""))
def rank_aware(spark, sf_dir):
    rows = gold(spark, sf_dir, ["subject_id", "has_img"])
    fixed = R.apply_rank_aware(rows, R.fit(rows, "score", "label"), "score", "has_img")
    return fixed.select("subject_id", "task", round_to("corrected").alias("corrected"))


@query("auc_null_pattern", sql(P, [PP, "nl AS (SELECT CASE WHEN has_img = 1 THEN pattern END AS pattern, icu_prediction AS score, icu_target AS label FROM pp)",
    *metric_ctes("nl", "pattern", "z")], f"SELECT pattern, n, n_pos, {r6('auc')} AS auc, {r6('ap')} AS ap, {r6('brier')} AS brier FROM zm"))
def auc_null_pattern(spark, sf_dir):
    """Rows whose group key is NULL form a group like any other."""
    df = predictions(spark, sf_dir).select(
        F.when(F.col("has_img") == 1, pattern_string()).alias("pattern"), F.col("icu_prediction").alias("score"), F.col("icu_target").alias("label")
    )
    m = M.ranking_metrics(df, ["pattern"])
    return m.select("pattern", "n", "n_pos", *[round_to(c).alias(c) for c in ("auc", "ap", "brier")])
