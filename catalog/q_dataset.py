"""Cleaning, scaling, splitting, sampling and epoch-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.functions.numeric import logit, round_to
from modalframe.functions.patterns import pattern_code
from modalframe.operators import clean, quantiles, sampling, scale, split, training
from modalframe.session import materialize

from .q_cohort import WIDE_CTES, WIDE_NUMERIC, WIDE_STRINGS, WIDE_VIEWS
from .q_cohort import wide as build_wide
from .q_vectors import _FLAG_CTES, flags
from .registry import query, r6, sql
from .views import view

P = ("v_predictions",)
FEATURES = [c for c in WIDE_NUMERIC if c not in clean.LEAKING]


def q(c: str) -> str:
    return f'"{c}"'


def unfilled(spark, sf_dir):
    """The wide table before gaps are filled, written once: the fits below read it more than once."""
    return materialize(build_wide(spark, sf_dir, fill=False), "wide")


def dataset(spark, sf_dir):
    """Wide features with flags, pattern and split, written once."""
    wide = build_wide(spark, sf_dir)
    both = wide.join(flags(spark, sf_dir).drop("missing_pattern"), "subject_id")
    stratum = split.stratum_of("death_after_discharge_180d", "readmission_30d", "pattern_code")
    return split.assign_split(materialize(both, "dataset"), stratum, few_strata=9)


def _raw_wide() -> str:
    """The wide CTE without the fills."""
    w = WIDE_CTES[-1].replace("wide AS", "raw AS", 1)
    for c in FEATURES + ["idx_severity_mode"]:
        w = w.replace(f"coalesce({c}, 0)", c)
    for c in WIDE_STRINGS:
        w = w.replace(f"coalesce(i.{c[4:]}, '')", f"i.{c[4:]}")
    return w


IMPUTE_COLS = list(WIDE_NUMERIC)
RAW = [*WIDE_CTES[:-1], _raw_wide()]
IMP = "imp AS (SELECT subject_id, " + ", ".join(f"coalesce({q(c)}::DOUBLE, avg({q(c)}) OVER (), 0.0) AS {q(c)}" for c in IMPUTE_COLS) + ", " + ", ".join(
    f"coalesce({c}, '') AS {c}" for c in WIDE_STRINGS) + " FROM raw)"
ST = "st AS (SELECT " + ", ".join(f"avg({q(c)}) AS {q('m_' + c)}, stddev_samp({q(c)}) AS {q('s_' + c)}" for c in IMPUTE_COLS) + " FROM imp)"


@query("impute_mean", sql(WIDE_VIEWS, [*RAW, IMP], "SELECT subject_id, " + ", ".join(f"{r6(q(c))} AS {q(c)}" for c in IMPUTE_COLS) + ", " + ", ".join(WIDE_STRINGS) + " FROM imp"))
def impute_mean(spark, sf_dir):
    df = clean.impute_mean(unfilled(spark, sf_dir))
    return df.select("subject_id", *[round_to(f"`{c}`").alias(c) for c in IMPUTE_COLS], *WIDE_STRINGS)


def _cap(c):
    v, m, s = q(c), q("m_" + c), q("s_" + c)
    return f"CASE WHEN {s} = 0 THEN {v} WHEN {v} < {m} - 3 * {s} THEN {m} - 3 * {s} WHEN {v} > {m} + 3 * {s} THEN {m} + 3 * {s} ELSE {v} END"


@query("winsorize", sql(WIDE_VIEWS, [*RAW, IMP, ST], "SELECT subject_id, " + ", ".join(f"{r6(_cap(c))} AS {q(c)}" for c in IMPUTE_COLS) + " FROM imp CROSS JOIN st"))
def winsorize(spark, sf_dir):
    df = clean.winsorize(clean.impute_mean(unfilled(spark, sf_dir)))
    return df.select("subject_id", *[round_to(f"`{c}`").alias(c) for c in IMPUTE_COLS])


@query("quality_report", sql(WIDE_VIEWS, [*RAW, IMP, ST], " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", (SELECT count(*) FILTER (WHERE {q(c)} IS NULL) FROM raw) AS n_missing,
 count(*) FILTER (WHERE {q('s_' + c)} > 0 AND {q(c)} > {q('m_' + c)} + 3 * {q('s_' + c)}) AS n_high,
 count(*) FILTER (WHERE {q('s_' + c)} > 0 AND {q(c)} < {q('m_' + c)} - 3 * {q('s_' + c)}) AS n_low FROM imp CROSS JOIN st""" for c in IMPUTE_COLS)))
def quality_report(spark, sf_dir):
    return clean.quality_report(unfilled(spark, sf_dir))


def split_ctes(source: str, ident: str, stratum: str) -> list[str]:
    return [
        f"sp0 AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5({ident} || ':42'), {ident}) AS rn, count(*) OVER (PARTITION BY {stratum}) AS ns FROM {source})",
        "sp1 AS (SELECT *, round(ns * 0.2::DOUBLE) AS nt FROM sp0)",
        "sp AS (SELECT * EXCLUDE (rn, ns, nt), CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + round((ns - nt) * 0.15::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM sp1)",
    ]


_PC = "CAST(8 * has_struct + 4 * has_img + 2 * has_text + has_rad AS INT)"
PRED = f"pr AS (SELECT *, {_PC} AS pattern_code FROM v_predictions)"
_STRATUM = "4 * mortality_target + 2 * readmission_target + CASE WHEN pattern_code = 15 THEN 1 ELSE 0 END"
SPLIT = [PRED, *split_ctes("pr", "subject_id", _STRATUM)]


def predictions(spark, sf_dir):
    return view(spark, sf_dir, "v_predictions").withColumn("pattern_code", pattern_code())


def split_predictions(spark, sf_dir):
    return split.assign_split(predictions(spark, sf_dir), split.stratum_of("mortality_target", "readmission_target", "pattern_code"))


@query("split_assign", sql(P, SPLIT, "SELECT subject_id, split FROM sp"))
def split_assign(spark, sf_dir):
    return split_predictions(spark, sf_dir).select("subject_id", "split")


_RATES = {"mortality_rate": "mortality_target", "readmission_rate": "readmission_target", "icu_rate": "icu_target", "complete_rate": "CASE WHEN pattern_code = 15 THEN 1 ELSE 0 END"}


@query("split_balance", sql(P, SPLIT, "SELECT split, count(*) AS n, " + ", ".join(f"{r6(f'avg({e})')} AS {k}" for k, e in _RATES.items()) + " FROM sp GROUP BY split"))
def split_balance(spark, sf_dir):
    b = split.split_balance(split_predictions(spark, sf_dir), "mortality_target", "readmission_target", "icu_target", "pattern_code")
    return b.select("split", "n", *[round_to(k).alias(k) for k in _RATES])


DS_STRATUM = "4 * death_after_discharge_180d + 2 * readmission_30d + CASE WHEN pattern_code = 15 THEN 1 ELSE 0 END"
DATASET = [*WIDE_CTES, *_FLAG_CTES, f"ds AS (SELECT wide.*, {_PC} AS pattern_code FROM wide JOIN mf USING (subject_id))", *split_ctes("ds", "subject_id", DS_STRATUM)]
DS_VIEWS = (*WIDE_VIEWS, "v_notes", "v_image_embeddings")
_FIT = {
    "robust": ("quantile_cont({v}, 0.5)", "quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)"),
    "minmax": ("min({v})", "max({v}) - min({v})"),
    "standard": ("avg({v})", "stddev_pop({v})"),
}


def _scale_sql(method):
    c_sql, s_sql = _FIT[method]
    fits = ", ".join(f"{c_sql.format(v=f'nullif({q(c)}, 0)::DOUBLE')} AS {q('c_' + c)}, {s_sql.format(v=f'nullif({q(c)}, 0)::DOUBLE')} AS {q('w_' + c)}" for c in FEATURES)
    near = 2.220446049250313e-15
    out = ", ".join(
        r6(f"CASE WHEN {q('c_' + c)} IS NULL THEN {q(c)}::DOUBLE WHEN {q(c)} <> 0 THEN ({q(c)} - {q('c_' + c)}) / CASE WHEN {q('w_' + c)} < {near} THEN 1.0 ELSE {q('w_' + c)} END ELSE 0.0 END")
        + f" AS {q(c)}" for c in FEATURES)
    return sql(DS_VIEWS, [*DATASET, f"ft AS (SELECT {fits} FROM sp WHERE split = 'train')"], f"SELECT subject_id, {out} FROM sp CROSS JOIN ft")


def _scaled(method):
    def run(spark, sf_dir):
        df = dataset(spark, sf_dir)
        scalers = scale.fit_scaler(df, FEATURES, method, F.col("split") == "train")
        return scale.apply_scaler(df, scalers).select("subject_id", *[round_to(f"`{c}`").alias(c) for c in FEATURES])

    return run


for _m in ("robust", "minmax", "standard"):
    query(f"scale_{_m}", _scale_sql(_m))(_scaled(_m))
query("scale_power")(_scaled("power"))


@query("power_likelihood", sql(DS_VIEWS, DATASET, " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, TRUE AS at_peak, 0.0::DOUBLE AS mean, CASE WHEN min({q(c)}) = max({q(c)}) THEN 0.0 ELSE 1.0 END::DOUBLE AS std
 FROM sp WHERE split = 'train' AND {q(c)} IS NOT NULL AND {q(c)} <> 0 HAVING count(*) > 0""" for c in FEATURES)))
def power_likelihood(spark, sf_dir):
    """The fitted lambda is no less likely than those 0.01 beside it, by the plain formulas; scaled training values have mean 0 and deviation 1."""
    df = dataset(spark, sf_dir).filter(F.col("split") == "train").select(*[f"`{c}`" for c in FEATURES])
    fits = scale.fit_scaler(df, FEATURES, "power")
    items = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x"), F.lit(s.power).alias("lam"), F.lit(s.center).alias("center"), F.lit(s.scale).alias("scale"))
        for c, s in fits.items() if not s.shift]
    assert len(items) == len(fits), "features of the test tables need no shifted powers"
    long = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").filter("x IS NOT NULL AND x <> 0")
    slope = F.sum(F.signum("x") * F.log1p(F.abs("x")))

    def likelihood(d):
        spread = F.var_pop(scale.yeo_johnson(F.col("x"), F.col("lam") + d))
        return -F.count(F.lit(1)) / 2.0 * F.log(F.nullif(spread, F.lit(0.0))) + (F.first("lam") + d - 1.0) * slope

    scaled = (scale.yeo_johnson(F.col("x"), F.col("lam")) - F.col("center")) / F.col("scale")
    each = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), *[likelihood(d).alias(k) for k, d in (("left", -0.01), ("here", 0.0), ("right", 0.01))],
        round_to(F.avg(scaled)).alias("mean"), round_to(F.stddev_pop(scaled)).alias("std"))
    peak = F.coalesce(F.col("here") + 1e-6 >= F.greatest("left", "right"), F.lit(True))
    return each.select("column", "n", peak.alias("at_peak"), "mean", "std")

_ORDER = [*[c for c in WIDE_STRINGS[:3]], "idx_los", *[c for c in WIDE_STRINGS[3:4]], "idx_hospital_expire_flag", *[c for c in WIDE_NUMERIC[2:] if c != "idx_severity_mode"]]


@query("struct_vector", sql(WIDE_VIEWS, WIDE_CTES, " UNION ALL ".join(
    f"SELECT subject_id, CAST({i} AS INT) AS pos, {r6(f'coalesce(TRY_CAST({q(c)} AS DOUBLE), 0.0)')} AS value FROM wide" for i, c in enumerate(_ORDER))))
def struct_vector(spark, sf_dir):
    wide = build_wide(spark, sf_dir)
    return scale.struct_vector(wide).select("subject_id", F.posexplode("x_struct").alias("pos", "v")).select("subject_id", "pos", round_to("v").alias("value"))


_QC = ["readmission_prediction", "icu_prediction", "mortality_prediction"]


@query("exact_quantiles", sql(P, [], " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS prob, {r6(f'quantile_cont({c}, {p})')} AS value FROM v_predictions" for c in _QC for p in (0.25, 0.5, 0.75))))
def exact_quantiles(spark, sf_dir):
    probs = (0.25, 0.5, 0.75)
    found = quantiles.exact_quantiles(view(spark, sf_dir, "v_predictions"), _QC, probs)
    rows = [(c, p, v) for c, vals in found.items() for p, v in zip(probs, vals)]
    return spark.createDataFrame(rows, "column string, prob double, value double").withColumn("value", round_to("value"))


@query("class_weights", sql(P, [], f"""SELECT CAST(label AS INT) AS label, n, {r6('t / (2.0::DOUBLE * n)')} AS weight FROM (SELECT mortality_target AS label, count(*) AS n, sum(count(*)) OVER () AS t FROM v_predictions GROUP BY mortality_target)"""))
def class_weights(spark, sf_dir):
    return sampling.class_weights(view(spark, sf_dir, "v_predictions"), "mortality_target").withColumn("weight", round_to("weight"))


COMPLEXITY = """pc AS (SELECT pattern_code, count(*) AS n, greatest(0.0, CASE WHEN pattern_code = 15 THEN 0.0 WHEN pattern_code & 8 <> 0 THEN 4 - bit_count(pattern_code) - 0.5
 WHEN pattern_code & 4 <> 0 THEN 4 - bit_count(pattern_code) - 0.3 ELSE 4 - bit_count(pattern_code) END)::DOUBLE AS complexity FROM pr GROUP BY pattern_code)"""


def allowed_cte(share):
    return [COMPLEXITY, f"""al AS (SELECT pattern_code, n, complexity, total FROM (SELECT *, row_number() OVER (ORDER BY complexity, pattern_code) AS r, count(*) OVER () AS k,
 sum(n) OVER () AS total FROM pc) WHERE r <= greatest(1, floor(k * {share}::DOUBLE)))"""]


@query("curriculum_patterns", sql(P, [PRED, *allowed_cte(0.7)], "SELECT pattern_code, complexity, n FROM al"))
def curriculum_patterns(spark, sf_dir):
    return sampling.allowed_patterns(predictions(spark, sf_dir), 50, 100).select("pattern_code", "complexity", "n")


def _curriculum(name, epoch, share):
    @query(name, sql(P, [PRED, *allowed_cte(share)], """SELECT subject_id, pattern_code FROM pr WHERE pattern_code IN (SELECT pattern_code FROM al)
 OR (SELECT sum(n) FROM al) < 0.1 * (SELECT max(total) FROM al)"""))
    def run(spark, sf_dir):
        return sampling.curriculum_subset(predictions(spark, sf_dir), epoch, 100).select("subject_id", "pattern_code")


_curriculum("curriculum_subset", 50, 0.7)
_curriculum("curriculum_subset_easy", 10, 0.4)


def weight_ctes(label, where="TRUE"):
    return [PRED, f"cell AS (SELECT {label} AS y, pattern_code, count(*) AS n FROM pr WHERE {where} GROUP BY ALL)",
        "cw AS (SELECT *, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY y) AS ny, sum(n) OVER (PARTITION BY pattern_code) AS np, "
        "(SELECT count(DISTINCT y) FROM cell) AS ky, (SELECT count(DISTINCT pattern_code) FROM cell) AS kp FROM cell)",
        "cx AS (SELECT *, 0.8::DOUBLE * CASE WHEN ky > 1 THEN t::DOUBLE / (ky * ny) ELSE 1 END + 0.2::DOUBLE * t / (kp * np) AS raw FROM cw)",
        "cy AS (SELECT *, raw / sum(raw * n) OVER () * t AS weight FROM cx)"]


@query("sample_weights", sql(P, weight_ctes("readmission_target", "pattern_code IN (10, 14, 12)"),
    f"SELECT pr.subject_id, {r6('coalesce(weight, 0.0)')} AS weight FROM pr LEFT JOIN cy ON pr.readmission_target = cy.y AND pr.pattern_code = cy.pattern_code"))
def sample_weights(spark, sf_dir):
    df = sampling.sample_weights(predictions(spark, sf_dir), "readmission_target", allowed=[10, 14, 12])
    return df.select("subject_id", round_to("weight").alias("weight"))


@query("sample_null_label", sql(P, ["pn AS (SELECT subject_id, CASE WHEN subject_id % 3 <> 0 THEN mortality_target END AS y, CASE WHEN has_rad = 1 OR has_img = 1 THEN CAST(8 * has_struct + 4 * has_img + 2 * has_text + has_rad AS INT) END AS pattern_code FROM v_predictions)",
    *[c.replace("FROM pr", "FROM pn") for c in weight_ctes("y", "y IS NOT NULL AND pattern_code IS NOT NULL")[1:]]],
    f"SELECT pn.subject_id, {r6('coalesce(weight, 0.0)')} AS weight FROM pn LEFT JOIN cy ON pn.y = cy.y AND pn.pattern_code = cy.pattern_code"))
def sample_null_label(spark, sf_dir):
    """Rows without a label or a pattern weigh nothing; the others' weights sum to their number."""
    df = view(spark, sf_dir, "v_predictions").select(
        "subject_id", F.when(F.col("subject_id") % 3 != 0, F.col("mortality_target")).alias("y"),
        F.when((F.col("has_rad") == 1) | (F.col("has_img") == 1), pattern_code()).alias("pattern_code"),
    )
    return sampling.sample_weights(df, "y").select("subject_id", round_to("weight").alias("weight"))


_U = "(('0x' || substr(md5(subject_id || '{0}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@query("weighted_sample", sql(P, [*weight_ctes("mortality_target"),
    "ci AS (SELECT *, sum(weight * n) OVER (ORDER BY y, pattern_code) / sum(weight * n) OVER () AS hi FROM cy)",
    "cj AS (SELECT * REPLACE (CASE WHEN lead(hi) OVER (ORDER BY y, pattern_code) IS NULL THEN 1.0 ELSE hi END AS hi), lag(hi, 1, 0.0) OVER (ORDER BY y, pattern_code) AS lo FROM ci)",
    "po AS (SELECT subject_id, mortality_target AS y, pattern_code, row_number() OVER (PARTITION BY mortality_target, pattern_code ORDER BY md5(subject_id || ':42'), subject_id) AS pos FROM pr)",
    f"dr AS (SELECT subject_id AS draw_id, {_U.format(':42:cell')} AS u1, {_U.format(':42:row')} AS u2 FROM pr)",
    "pk AS (SELECT draw_id, y, pattern_code, CAST(floor(u2 * n) + 1 AS BIGINT) AS pos FROM dr JOIN cj ON u1 >= lo AND u1 < hi)"],
    "SELECT draw_id, subject_id FROM pk JOIN po USING (y, pattern_code, pos)"))
def weighted_sample(spark, sf_dir):
    return sampling.weighted_sample(predictions(spark, sf_dir), "mortality_target")


L = ("v_epoch_metrics",)
_BASE = "CASE task WHEN 'readmission' THEN 1.2 WHEN 'icu' THEN 1.0 ELSE 1.5 END::DOUBLE"
_LOW = "CASE task WHEN 'mortality' THEN 1.0 ELSE 0.5 END::DOUBLE"
_HIGH = "CASE task WHEN 'readmission' THEN 2.0 WHEN 'icu' THEN 1.5 ELSE 3.0 END::DOUBLE"


@query("adaptive_weights", sql(L, ["""a AS (SELECT run, epoch, task, avg(auc) OVER w AS r, count(auc) OVER w AS k FROM v_epoch_metrics
 WINDOW w AS (PARTITION BY run, task ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"""],
    f"""SELECT CAST(run AS BIGINT) AS run, CAST(epoch AS BIGINT) AS epoch, task, {r6(f'''CASE WHEN epoch > 5 AND k = 3 AND r < 0.75 THEN least({_HIGH}, {_BASE} * (1.5 - r))
 WHEN epoch > 5 AND k = 3 AND r > 0.85 THEN greatest({_LOW}, {_BASE} * (0.8 + 0.2 * r)) ELSE {_BASE} END''')} AS weight FROM a"""))
def adaptive_weights(spark, sf_dir):
    w = training.adaptive_weights(view(spark, sf_dir, "v_epoch_metrics"))
    return w.select(F.col("run").cast("long").alias("run"), F.col("epoch").cast("long").alias("epoch"), "task", round_to("weight").alias("weight"))


@query("best_epoch", sql(L, [
    """s AS (SELECT run, epoch, 0.45 * max(auc) FILTER (WHERE task = 'readmission') + 0.35 * max(auc) FILTER (WHERE task = 'mortality')
 + 0.20 * max(auc) FILTER (WHERE task = 'icu') AS score FROM v_epoch_metrics GROUP BY run, epoch)""",
    "b AS (SELECT *, coalesce(max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS best, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM s)",
    "c AS (SELECT *, i - coalesce(max(CASE WHEN score > best THEN i END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS stale FROM b)",
    "d AS (SELECT *, min(CASE WHEN stale >= 15 THEN epoch END) OVER (PARTITION BY run) AS stop FROM c)"],
    f"""SELECT CAST(run AS BIGINT) AS run, CAST(max(CASE WHEN score > best THEN epoch END) AS BIGINT) AS best_epoch, {r6('max(CASE WHEN score > best THEN score END)')} AS best_score,
 CAST(max(stop) AS BIGINT) AS stop_epoch, count(*) AS epochs_run FROM d WHERE stop IS NULL OR epoch <= stop GROUP BY run"""))
def best_epoch(spark, sf_dir):
    b = training.best_epoch(view(spark, sf_dir, "v_epoch_metrics"))
    return b.select(*[F.col(c).cast("long").alias(c) for c in ("run", "best_epoch", "stop_epoch", "epochs_run")], round_to("best_score").alias("best_score"))


def _logit(p):
    return f"ln(least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)))"


_N = "(('0x' || substr(md5(subject_id || ':' || r || ':' || i || ':42'), {0}, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
_WEIGHTS = (0.5, 0.3, 0.2)


@query("tta_average", sql(P, [
    "x AS (" + " UNION ALL ".join(f"SELECT subject_id, {i} AS i, {w}::DOUBLE AS w, {_logit(c)} AS v FROM v_predictions" for i, (c, w) in enumerate(zip(_QC, _WEIGHTS))) + ")",
    "rp AS (SELECT x.*, g.r FROM x CROSS JOIN generate_series(0, 4) g(r))",
    f"sc AS (SELECT subject_id, r, sum(w * (v + CASE WHEN r = 0 THEN 0.0 ELSE 0.01::DOUBLE * sqrt(-2 * ln(1 - {_N.format(1)})) * cos({_N.format(14)} * 6.283185307179586::DOUBLE) END)) AS logit FROM rp GROUP BY subject_id, r)"],
    f"SELECT subject_id, {r6('avg(logit)')} AS mean_logit, {r6('1 / (1 + exp(-avg(logit)))')} AS probability FROM sc GROUP BY subject_id"))
def tta_average(spark, sf_dir):
    df = view(spark, sf_dir, "v_predictions").select("subject_id", F.array(*[logit(c) for c in _QC]).alias("x"))
    mean, prob = training.augmented_probability("x", "subject_id", lambda v: sum((w * v[i] for i, w in enumerate(_WEIGHTS)), F.lit(0.0)))
    return df.select("subject_id", round_to(mean).alias("mean_logit"), round_to(prob).alias("probability"))


@query("tta_replicas", sql(P, [
    "x AS (" + " UNION ALL ".join(f"SELECT subject_id, {i} AS i, {w}::DOUBLE AS w, {_logit(c)} AS v FROM v_predictions" for i, (c, w) in enumerate(zip(_QC, _WEIGHTS))) + ")",
    "rp AS (SELECT x.*, g.r FROM x CROSS JOIN generate_series(0, 4) g(r))",
    f"sc AS (SELECT subject_id, r, sum(w * (v + CASE WHEN r = 0 THEN 0.0 ELSE 0.01::DOUBLE * sqrt(-2 * ln(1 - {_N.format(1)})) * cos({_N.format(14)} * 6.283185307179586::DOUBLE) END)) AS logit FROM rp GROUP BY subject_id, r)"],
    f"SELECT subject_id, {r6('avg(logit)')} AS mean_logit, {r6('1 / (1 + exp(-avg(logit)))')} AS probability FROM sc GROUP BY subject_id"))
def tta_replicas(spark, sf_dir):
    df = view(spark, sf_dir, "v_predictions").select("subject_id", F.array(*[logit(c) for c in _QC]).alias("x"))
    scored = training.replicate(df, "x", "subject_id").withColumn("logit", sum((w * F.col("x")[i] for i, w in enumerate(_WEIGHTS)), F.lit(0.0)))
    avg = training.average_replicas(scored, "subject_id")
    return avg.select("subject_id", round_to("mean_logit").alias("mean_logit"), round_to("probability").alias("probability"))


_RANK = "rk AS (SELECT *, (row_number() OVER (ORDER BY readmission_prediction, subject_id) - 1)::DOUBLE / (count(*) OVER () - 1) AS r FROM v_predictions)"


@query("rank_sigmoid", sql(P, [_RANK], f"SELECT subject_id, {r6('1 / (1 + exp(-6.0 * (r - 0.5)))')} AS normalized FROM rk"))
def rank_sigmoid(spark, sf_dir):
    df = view(spark, sf_dir, "v_predictions").select("subject_id", "readmission_prediction")
    return quantiles.rank_sigmoid(df, "readmission_prediction", "subject_id").select("subject_id", round_to("normalized").alias("normalized"))


@query("quantile_match", sql(P, [_RANK,
    "rf AS (SELECT icu_prediction AS v, row_number() OVER (ORDER BY icu_prediction, subject_id) - 1 AS i, count(*) OVER () AS m FROM v_predictions WHERE has_img = 1)",
    "ps AS (SELECT subject_id, r * ((SELECT max(m) FROM rf) - 1) AS pos FROM rk)",
    "pf AS (SELECT subject_id, pos, CAST(floor(pos) AS BIGINT) AS lo FROM ps)"],
    f"SELECT subject_id, {r6('least(greatest(a.v + (coalesce(b.v, a.v) - a.v) * (pos - lo), 0.0), 1.0)')} AS normalized FROM pf JOIN rf a ON a.i = lo LEFT JOIN rf b ON b.i = lo + 1"))
def quantile_match(spark, sf_dir):
    df = view(spark, sf_dir, "v_predictions")
    ref = df.filter(F.col("has_img") == 1).select("subject_id", "icu_prediction")
    out = quantiles.quantile_match(df.select("subject_id", "readmission_prediction"), ref, "readmission_prediction", "subject_id", "icu_prediction", "subject_id")
    return out.select("subject_id", round_to("normalized").alias("normalized"))
