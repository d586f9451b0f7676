"""Pattern-wise correction, loss and contrastive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from modalframe.functions.numeric import logit, round_to
from modalframe.operators import correction as K
from modalframe.operators import losses
from modalframe.operators.metrics import stack_scores

from .q_dataset import _logit
from .q_predictions import FIT_CTES, P, PP, metric_ctes, rank_aware_sql, transform_ctes
from .q_vectors import EP, EXPLODED, FLAGGED, four_modalities
from .registry import query, r6, sql
from .views import view

# --- working table and baseline
PL2 = """pl AS (SELECT 'readmission' AS task, subject_id, pattern, readmission_prediction AS score, readmission_target AS label FROM pp
 UNION ALL SELECT 'icu', subject_id, pattern, icu_prediction, icu_target FROM pp)"""
BASE = [PP, PL2, *metric_ctes("pl", "pattern, task", "b"),
    """bl AS (SELECT pattern, max(n) AS n, max(auc) FILTER (WHERE task = 'readmission') AS readm_auc, max(ap) FILTER (WHERE task = 'readmission') AS readm_apr,
 max(auc) FILTER (WHERE task = 'icu') AS icu_auc, max(ap) FILTER (WHERE task = 'icu') AS icu_apr FROM bm GROUP BY pattern HAVING max(n) >= 10)""",
    "rs0 AS (SELECT *, length(replace(pattern, '0', '')) / 4.0::DOUBLE AS completeness, CASE WHEN readm_auc > 0.9 AND n < 200 THEN 0.9 ELSE readm_auc END AS a FROM bl)",
    """rs AS (SELECT *, CASE WHEN n >= 60 AND completeness >= 0.25 THEN a * 0.6::DOUBLE + least(1.0, n / 200.0::DOUBLE) * 0.3::DOUBLE + completeness * 0.1::DOUBLE END AS score FROM rs0)""",
    "rf AS (SELECT pattern, score FROM rs WHERE score IS NOT NULL ORDER BY score DESC, pattern LIMIT 1)"]
FITTED = [*BASE, *FIT_CTES, """pm AS (SELECT s.pattern, CASE WHEN s.pattern = (SELECT pattern FROM rf) THEN 'reference' WHEN s.n < 10 THEN 'too_small' WHEN s.n < 20 THEN 'unfitted' ELSE 'corrected' END AS status,
 s.n, r.delta AS d_readm, i.delta AS d_icu FROM (SELECT pattern, count(*) AS n FROM pp GROUP BY pattern) s
 LEFT JOIN fit r ON r.modality = s.pattern AND r.task = 'readmission' LEFT JOIN fit i ON i.modality = s.pattern AND i.task = 'icu')"""]


def strength_sql(task, p="pattern"):
    base, weights, multipliers = K.STRENGTH[task]
    factor = f"({base}" + "".join(f" + CASE WHEN substr({p}, {i + 1}, 1) = '0' THEN {w} ELSE 0 END" for i, w in enumerate(weights)) + ")::DOUBLE"
    boost = "CASE " + " ".join(f"WHEN {p} = '{k}' THEN {v}" for k, v in multipliers.items()) + " ELSE 1.0 END::DOUBLE" if multipliers else "1.0::DOUBLE"
    return f"({factor} * {boost})"


GAINS = """gt AS (SELECT pattern, max(auc) FILTER (WHERE task = 'readm_new') - max(auc) FILTER (WHERE task = 'readm_now') AS rg,
 max(auc) FILTER (WHERE task = 'icu_new') - max(auc) FILTER (WHERE task = 'icu_now') AS ig,
 max(brier) FILTER (WHERE task = 'icu_now') - max(brier) FILTER (WHERE task = 'icu_new') AS ib FROM gm GROUP BY pattern)"""

# icu: adaptive delta on the current scores (transform_ctes works on (task, pattern) groups), candidate, gate
STEP = [*FITTED, *transform_ctes("(SELECT * FROM pl WHERE task = 'icu')", "fit"),
    f"sh AS (SELECT modality AS pattern, delta_adj * {strength_sql('icu', 'modality')} * 1.5::DOUBLE AS shift FROM ttr)",
    f"""k0 AS (SELECT pp.*, pm.status, pm.d_readm, pm.d_icu, {rank_aware_sql('readmission_prediction', 'd_readm')} AS c_readm, icu_prediction - shift AS q0
 FROM pp JOIN pm USING (pattern) LEFT JOIN sh USING (pattern))""",
    "k1 AS (SELECT *, CASE WHEN q0 >= 0.45::DOUBLE AND q0 <= 0.55::DOUBLE THEN q0 - 0.07::DOUBLE * sign(q0 - 0.5) ELSE q0 END AS q1 FROM k0)",
    """k2 AS (SELECT *, least(greatest(CASE WHEN q1 > 0.8 AND icu_target = 0 THEN q1 - 0.15::DOUBLE WHEN q1 < 0.2 AND icu_target = 1 THEN q1 + 0.15::DOUBLE ELSE q1 END, 0.001), 0.999) AS c_icu FROM k1)""",
    """gl AS (SELECT 'readm_now' AS task, pattern, readmission_prediction AS score, readmission_target AS label FROM k2 WHERE status = 'corrected'
 UNION ALL SELECT 'readm_new', pattern, c_readm, readmission_target FROM k2 WHERE status = 'corrected'
 UNION ALL SELECT 'icu_now', pattern, icu_prediction, icu_target FROM k2 WHERE status = 'corrected'
 UNION ALL SELECT 'icu_new', pattern, c_icu, icu_target FROM k2 WHERE status = 'corrected')""",
    *metric_ctes("gl", "pattern, task", "g"),
    GAINS]


def gate_cte(selective):
    w_readm = "CASE WHEN rg > 0 THEN 0.9" + ("" if selective else " WHEN abs(rg) < 0.005 THEN 0.3 WHEN rg IS NOT NULL THEN 0.1") + " END::DOUBLE"
    gate = "(ig > -0.0005 OR ib > 0.001)" if selective else "TRUE"
    w_icu = f"CASE WHEN ig IS NULL OR NOT {gate} THEN NULL WHEN ig > 0 THEN least(0.95, 0.85 + 3 * ig) WHEN ib > 0 AND abs(ig) < 0.005 THEN 0.4 ELSE 0.2 END::DOUBLE"
    return f"gw AS (SELECT *, {w_readm} AS wr, {w_icu} AS wi FROM gt)"


def nudge_sql(label):
    return f"""CASE WHEN c_readm > 0.4 AND c_readm < 0.6 THEN 0.05::DOUBLE * sign(c_readm - 0.5) WHEN c_readm > 0.7 AND {label} = 0 THEN -0.1
 WHEN c_readm < 0.3 AND {label} = 1 THEN 0.1 ELSE 0 END::DOUBLE"""


def ensemble_sql(icu0, y_icu, readm0):
    return f"""least(greatest(0.5 * icu + 0.2::DOUBLE * ({icu0} - 0.2::DOUBLE * di) + 0.2::DOUBLE * ({icu0} - 1.05::DOUBLE * di)
 + 0.1::DOUBLE * CASE WHEN {icu0} > 0.8 AND {y_icu} = 0 THEN {icu0} - 0.2 WHEN {icu0} < 0.2 AND {y_icu} = 1 THEN {icu0} + 0.2 ELSE {icu0} END, 0.0), 1.0) AS icu_ensemble,
 least(greatest(0.6::DOUBLE * readm + 0.15::DOUBLE * ({readm0} - 0.2::DOUBLE * coalesce(dr, 0)) + 0.15::DOUBLE * ({readm0} - 0.78::DOUBLE * coalesce(dr, 0))
 + 0.1::DOUBLE * {rank_aware_sql(readm0, "dr")}, 0.0), 1.0) AS readm_ensemble"""


def step_ctes(selective):
    return [*STEP, gate_cte(selective),
        f"""n1 AS (SELECT k2.*, CASE WHEN wr IS NULL THEN readmission_prediction ELSE least(greatest(wr * c_readm + (1 - wr) * readmission_prediction + 0.3::DOUBLE * {nudge_sql('readmission_target')}, 0.001), 0.999) END AS readm,
 CASE WHEN wi IS NULL THEN icu_prediction ELSE wi * c_icu + (1 - wi) * icu_prediction END AS icu, CASE WHEN status = 'corrected' THEN d_icu ELSE 0 END AS di,
 CASE WHEN status = 'corrected' THEN d_readm END AS dr FROM k2 LEFT JOIN gw USING (pattern))""",
        f"n2 AS (SELECT *, {ensemble_sql('icu_prediction', 'icu_target', 'readmission_prediction')} FROM n1)"]


def prepared(spark, sf_dir):
    return K.prepare(view(spark, sf_dir, "v_predictions"))


def one_step(spark, sf_dir, selective=False):
    state = prepared(spark, sf_dir)
    splits = K.score_splits(state)
    reference = K.choose_reference(K.baseline_metrics(state, splits)).first()["pattern"]
    ref_row = spark.createDataFrame([(reference,)], "pattern string")
    params = K.pattern_parameters(state, reference, K.fit_rectifiers(state, ref_row))
    cand = K.candidates(state, params)
    return K.blend(cand, K.gates(cand, selective, splits))


@query("baseline_by_pattern", sql(P, BASE, "SELECT pattern, n, " + ", ".join(f"{r6(c)} AS {c}" for c in ("readm_auc", "readm_apr", "icu_auc", "icu_apr")) + " FROM bl"))
def baseline_by_pattern(spark, sf_dir):
    b = K.baseline_metrics(prepared(spark, sf_dir))
    return b.select("pattern", "n", *[round_to(c).alias(c) for c in ("readm_auc", "readm_apr", "icu_auc", "icu_apr")])


@query("reference_scores", sql(P, BASE, f"SELECT pattern, n, {r6('completeness')} AS completeness, {r6('score')} AS score FROM rs"))
def reference_scores(spark, sf_dir):
    r = K.reference_scores(K.baseline_metrics(prepared(spark, sf_dir)))
    return r.select("pattern", "n", round_to("completeness").alias("completeness"), round_to("score").alias("score"))


@query("reference_pattern", sql(P, BASE, f"SELECT pattern, {r6('score')} AS score FROM rf"))
def reference_pattern(spark, sf_dir):
    r = K.choose_reference(K.baseline_metrics(prepared(spark, sf_dir)))
    return r.select("pattern", round_to("score").alias("score"))


@query("strength_table", sql(P, [PP], "SELECT pattern, count(*) AS n, " + ", ".join(f"{r6(strength_sql(t))} AS {t}" for t in K.STRENGTH) + " FROM pp GROUP BY pattern"))
def strength_table(spark, sf_dir):
    sizes = prepared(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("pattern", "n", *[round_to(K.strength("pattern", t)).alias(t) for t in K.STRENGTH])


@query("correction_fit", sql(P, [*FITTED], f"""SELECT task, CASE WHEN f.modality = (SELECT pattern FROM rf) THEN 'full' ELSE 'pattern_' || f.modality END AS modality,
 {r6('delta')} AS delta, {r6('var_delta')} AS var_delta, n FROM fit f WHERE n >= 20 OR f.modality = (SELECT pattern FROM rf)"""))
def correction_fit(spark, sf_dir):
    state = prepared(spark, sf_dir)
    fit = K.fit_rectifiers(state, K.choose_reference(K.baseline_metrics(state)))
    return fit.select("task", "modality", round_to("delta").alias("delta"), round_to("var_delta").alias("var_delta"), "n")


def _step(name, column, selective=False):
    @query(name, sql(P, step_ctes(selective), f"SELECT subject_id, status, {r6(column)} AS {column} FROM n2"))
    def run(spark, sf_dir):
        rows = one_step(spark, sf_dir, selective).withColumn("readm_ensemble", K.readm_ensemble())
        return rows.select(F.col("id").alias("subject_id"), "status", round_to(column).alias(column))


_step("readm_step1", "readm")
_step("readm_step1_selective", "readm", True)
_step("icu_step1", "icu")
_step("icu_step1_selective", "icu", True)
_step("icu_ensemble", "icu_ensemble")
_step("readm_ensemble", "readm_ensemble")


def iteration_ctes(i, selective):
    """Iteration `i` (from 1) on `st{i-1}`: `it{i}` its blended scores, `au{i}` their overall AUCs, `st{i}` after adoption of a better icu ensemble."""
    rate = f"{K.learning_rate(i - 1)!r}::DOUBLE"
    inner = ["src AS (SELECT * FROM st%d)" % (i - 1), "tl AS (SELECT 'icu' AS task, pattern, icu AS score FROM src)", *transform_ctes("tl", "fit"),
        f"sh AS (SELECT modality AS pattern, delta_adj * {rate} * {strength_sql('icu', 'modality')} * 1.5::DOUBLE AS shift FROM ttr)",
        f"k0 AS (SELECT src.*, {rank_aware_sql('readm', 'd_readm')} AS c_readm, icu - shift AS q0 FROM src LEFT JOIN sh USING (pattern))",
        "k1 AS (SELECT *, CASE WHEN q0 >= 0.45::DOUBLE AND q0 <= 0.55::DOUBLE THEN q0 - 0.07::DOUBLE * sign(q0 - 0.5) ELSE q0 END AS q1 FROM k0)",
        "k2 AS (SELECT *, least(greatest(CASE WHEN q1 > 0.8 AND y_i = 0 THEN q1 - 0.15::DOUBLE WHEN q1 < 0.2 AND y_i = 1 THEN q1 + 0.15::DOUBLE ELSE q1 END, 0.001), 0.999) AS c_icu FROM k1)",
        "gl AS (" + " UNION ALL ".join(f"SELECT '{t}' AS task, pattern, {c} AS score, {y} AS label FROM k2 WHERE status = 'corrected'"
            for t, c, y in (("readm_now", "readm", "y_r"), ("readm_new", "c_readm", "y_r"), ("icu_now", "icu", "y_i"), ("icu_new", "c_icu", "y_i"))) + ")",
        *metric_ctes("gl", "pattern, task", "g"), GAINS, gate_cte(selective),
        f"""n1 AS (SELECT k2.* EXCLUDE (readm, icu), CASE WHEN wr IS NULL THEN readm ELSE least(greatest(wr * c_readm + (1 - wr) * readm + 0.3::DOUBLE * {nudge_sql('y_r')}, 0.001), 0.999) END AS readm,
 CASE WHEN wi IS NULL THEN icu ELSE wi * c_icu + (1 - wi) * icu END AS icu, CASE WHEN status = 'corrected' THEN d_icu ELSE 0 END AS di,
 CASE WHEN status = 'corrected' THEN d_readm END AS dr FROM k2 LEFT JOIN gw USING (pattern))"""]
    outer = f"SELECT subject_id, pattern, readm0, icu0, y_r, y_i, status, d_readm, d_icu, readm, icu, {ensemble_sql('icu0', 'y_i', 'readm0')} FROM n1"
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS task, {c} AS score, {y} AS label FROM it{i}" for c, y in (("readm", "y_r"), ("readm_ensemble", "y_r"), ("icu", "y_i"), ("icu_ensemble", "y_i")))
    auc = [f"ol AS ({stacked})", *metric_ctes("ol", "task", "o")]
    return [f"it{i} AS MATERIALIZED (WITH " + ", ".join(inner) + " " + outer + ")",
        f"au{i} AS MATERIALIZED (WITH " + ", ".join(auc) + " SELECT " + ", ".join(f"max(auc) FILTER (WHERE task = '{c}') AS {c}" for c in ("readm", "readm_ensemble", "icu", "icu_ensemble")) + " FROM om)",
        f"st{i} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN (SELECT icu < icu_ensemble FROM au{i}) THEN icu_ensemble ELSE icu END AS icu) FROM it{i})"]


def full_ctes(n, selective):
    """`res`: the corrected rows after at most `n` iterations, roll-back and the final choice between ensemble and best iteration."""
    steps = range(1, n + 1)
    return [*FITTED, """st0 AS MATERIALIZED (SELECT subject_id, pattern, readmission_prediction AS readm0, icu_prediction AS icu0, readmission_target AS y_r, icu_target AS y_i, status, d_readm, d_icu,
 readmission_prediction AS readm, icu_prediction AS icu FROM pp JOIN pm USING (pattern))""",
        *(c for i in steps for c in iteration_ctes(i, selective)),
        "hs AS (" + " UNION ALL ".join(f"SELECT {i} AS i, * FROM au{i}" for i in steps) + ")",
        "hr AS (SELECT *, coalesce(readm < lag(readm) OVER (ORDER BY i) * 0.999::DOUBLE, FALSE) AS rolled FROM hs)",
        f"hk AS (SELECT coalesce(min(i) FILTER (WHERE rolled), {n}) AS last, coalesce(min(i) FILTER (WHERE rolled) - 1, {n}) AS kept FROM hr)",
        """pk AS (SELECT CASE WHEN k.readm < k.readm_ensemble THEN 0 ELSE (SELECT i FROM hr, hk WHERE i <= last ORDER BY readm DESC, i LIMIT 1) END AS best, hk.kept FROM hk JOIN hr k ON k.i = hk.kept)""",
        "al AS (" + " UNION ALL ".join(f"SELECT {i} AS i, * FROM st{i}" for i in steps) + ")",
        """res AS (SELECT subject_id, status, y_r, y_i, readm0, icu0, icu, CASE WHEN best = 0 THEN readm_ensemble ELSE readm END AS readm
 FROM al, pk WHERE al.i = CASE WHEN best = 0 THEN kept ELSE best END)"""]


def _full(name, selective, iterations=K.MAX_ITERATIONS):
    columns = {"readm0": "readm_pred_original", "readm": "readm_pred_corrected", "icu0": "icu_pred_original", "icu": "icu_pred_corrected"}

    @query(name, sql(P, full_ctes(iterations, selective), "SELECT subject_id, CAST(y_r AS DOUBLE) AS readm_target, CAST(y_i AS DOUBLE) AS icu_target, status, " + ", ".join(f"{r6(c)} AS {out}" for c, out in columns.items()) + " FROM res"))
    def run(spark, sf_dir):
        done = K.correct_predictions(view(spark, sf_dir, "v_predictions"), selective, max_iterations=iterations)
        return done.rows.select("subject_id", "readm_target", "icu_target", "status", *[round_to(c).alias(c) for c in columns.values()])


_full("correct_full_selective", True)
_full("correct_full_all", False)
_full("correct_two_iterations", False, 2)

_SIDES = " UNION ALL ".join(f"SELECT '{t}' AS task, '{side}' AS side, {c} AS score, {y} AS label FROM res"
    for t, y, cs in (("readmission", "y_r", ("readm0", "readm")), ("icu", "y_i", ("icu0", "icu"))) for side, c in zip(("before", "after"), cs))


@query("correction_comparison", sql(P, [*full_ctes(K.MAX_ITERATIONS, False), f"sd AS ({_SIDES})", *metric_ctes("sd", "task, side", "s"),
    "ml AS (" + " UNION ALL ".join(f"SELECT task, '{m}' AS metric, max({m}) FILTER (WHERE side = 'before') AS b, max({m}) FILTER (WHERE side = 'after') AS a FROM sm GROUP BY task" for m in ("auc", "ap", "brier")) + ")"],
    f"SELECT task, metric, {r6('b')} AS before, {r6('a')} AS after, {r6('a - b')} AS delta FROM ml"))
def correction_comparison(spark, sf_dir):
    m = K.correct_predictions(view(spark, sf_dir, "v_predictions"), False).metrics()
    return m.select("task", "metric", *[round_to(c).alias(c) for c in ("before", "after", "delta")])


# --- losses on logits
_TASKS = (("readmission", "readmission"), ("icu", "icu"), ("mortality", "mortality"))
LG = "lg AS (" + " UNION ALL ".join(f"SELECT subject_id, '{t}' AS task, {_logit(f'{c}_prediction')} AS x, {c}_target::DOUBLE AS y FROM v_predictions" for t, c in _TASKS) + ")"
_SP = "(greatest({0}, 0.0) + ln(1 + exp(-abs({0}))))"
LB = f"lb AS (SELECT *, (1 - y) * {_SP.format('x')} + y * {_SP.format('(-x)')} AS bce, (1 - (y * 0.9::DOUBLE + 0.05::DOUBLE)) * {_SP.format('x')} + (y * 0.9::DOUBLE + 0.05::DOUBLE) * {_SP.format('(-x)')} AS smooth FROM lg)"
_PROGRESS = 0.5


def _focal_sql():
    case = " ".join(f"WHEN '{t}' THEN pow(1 - exp(-bce), {s + (e - s) * _PROGRESS}::DOUBLE) * bce * {a}::DOUBLE" for t, (a, s, e) in losses.FOCAL.items())
    return f"CASE task {case} END"


def logits(spark, sf_dir):
    df = view(spark, sf_dir, "v_predictions")
    long = stack_scores(df, {t: (logit(f"{c}_prediction"), f"{c}_target") for t, c in _TASKS}, ["subject_id"])
    return long.withColumnRenamed("score", "logit")


@query("bce_loss", sql(P, [LG, LB], f"""SELECT task, n, {r6('w')} AS pos_weight, {r6('(neg + w * pos) / n')} AS loss FROM (SELECT task, count(*) AS n,
 CASE WHEN task = 'mortality' THEN count(*) / (2 * sum(y)) ELSE 1.0 END::DOUBLE AS w, sum((1 - y) * {_SP.format('x')}) AS neg, sum(y * {_SP.format('(-x)')}) AS pos FROM lb GROUP BY task)"""))
def bce_loss(spark, sf_dir):
    out = losses.bce_loss(logits(spark, sf_dir))
    return out.select("task", "n", round_to("pos_weight").alias("pos_weight"), round_to("loss").alias("loss"))


@query("focal_loss", sql(P, [LG, LB], f"SELECT task, count(*) AS n, {r6(f'avg({_focal_sql()})')} AS loss FROM lb GROUP BY task"))
def focal_loss(spark, sf_dir):
    return losses.focal_loss(logits(spark, sf_dir), _PROGRESS).withColumn("loss", round_to("loss"))


@query("smoothing_loss", sql(P, [LG, LB], f"SELECT task, count(*) AS n, {r6('avg(smooth)')} AS loss FROM lb GROUP BY task"))
def smoothing_loss(spark, sf_dir):
    return losses.smoothing_loss(logits(spark, sf_dir)).withColumn("loss", round_to("loss"))


@query("compound_loss", sql(P, [LG, LB, f"""cl AS (SELECT task, CASE WHEN task = 'mortality' THEN 0.9 * avg({_focal_sql()}) + 0.1 * avg(smooth) ELSE 0.7 * avg({_focal_sql()}) + 0.3 * avg(smooth) END AS loss FROM lb GROUP BY task)"""],
    "SELECT task, " + r6("loss") + " AS loss FROM cl UNION ALL SELECT 'total', " + r6("sum(loss * CASE task WHEN 'readmission' THEN 1.2 WHEN 'icu' THEN 1.0 ELSE 1.5 END)") + " FROM cl"))
def compound_loss(spark, sf_dir):
    return losses.compound_loss(logits(spark, sf_dir), _PROGRESS).withColumn("loss", round_to("loss"))


@query("recon_mse", sql(EP, [EXPLODED, FLAGGED, "pmn AS (SELECT subject_id, pos, avg(x) AS m, max(x) AS h FROM ex GROUP BY subject_id, pos)",
    """ms AS (SELECT 'img' AS modality, count(DISTINCT vec_id) AS n, avg((m - x) * (m - x)) AS mse FROM fl JOIN pmn USING (subject_id, pos) WHERE has_img = 1
 UNION ALL SELECT 'text', count(DISTINCT vec_id), avg((h - x) * (h - x)) FROM fl JOIN pmn USING (subject_id, pos) WHERE has_text = 1
 UNION ALL SELECT 'rad', count(DISTINCT vec_id), avg(x * x) FROM fl WHERE has_rad = 1)"""],
    f"SELECT modality, n, {r6('mse')} AS mse FROM ms UNION ALL SELECT 'overall', CAST(sum(n) AS BIGINT), {r6('avg(mse)')} FROM ms"))
def recon_mse(spark, sf_dir):
    from modalframe.operators.pooling import pool_vectors

    df = four_modalities(spark, sf_dir)
    images = view(spark, sf_dir, "v_image_embeddings")
    df = df.join(pool_vectors(images, "subject_id", "embedding", "mean", "mean_v").drop("n_vectors"), "subject_id")
    df = df.join(pool_vectors(images, "subject_id", "embedding", "max_pool", "max_v").drop("n_vectors"), "subject_id")
    df = df.withColumn("none", F.transform("x_struct", lambda x: F.lit(0.0)))
    triples = {"img": ("mean_v", "x_struct", "has_img"), "text": ("max_v", "x_struct", "has_text"), "rad": ("none", "x_struct", "has_rad")}
    return losses.reconstruction_mse(df, triples).withColumn("mse", round_to("mse"))


BATCH = """bt AS (SELECT vec_id, concat(has_struct, has_img, has_text, has_rad) AS pattern, CAST(floor((row_number() OVER (ORDER BY md5(vec_id || ':42'), vec_id) - 1) / 32) AS BIGINT) AS batch_id
 FROM v_image_embeddings e JOIN v_predictions p ON e.vec_id = p.subject_id)"""
PAIRS = """nx AS (SELECT vec_id, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM ex)""", \
    """pa AS (SELECT a.batch_id, a.vec_id, b.vec_id AS other, a.pattern = b.pattern AND a.vec_id <> b.vec_id AS pos_pair, sum(x.x * y.x) / 0.1 AS sim
 FROM bt a JOIN bt b ON a.batch_id = b.batch_id JOIN nx x ON x.vec_id = a.vec_id JOIN nx y ON y.vec_id = b.vec_id AND y.pos = x.pos GROUP BY ALL)"""


_WHOLE = BATCH.replace("CAST(floor((row_number() OVER (ORDER BY md5(vec_id || ':42'), vec_id) - 1) / 32) AS BIGINT)", "CAST(vec_id % 3 AS BIGINT)")


def _contrastive(name, top, bottom, plain, tile=losses.TILE_ROWS, batches=BATCH):
    @query(name, sql(EP, [EXPLODED, batches, *PAIRS], f"""SELECT batch_id, vec_id, count(*) FILTER (WHERE pos_pair) AS n_positive, {r6(f'-ln({top} / {bottom})', 5)} AS loss
 FROM pa GROUP BY batch_id, vec_id HAVING count(*) FILTER (WHERE pos_pair) > 0"""))
    def run(spark, sf_dir):
        df = four_modalities(spark, sf_dir).select("vec_id", "pattern", "x_struct")
        df = losses.assign_batches(df, "vec_id") if batches == BATCH else df.withColumn("batch_id", F.pmod("vec_id", F.lit(3)).cast("long"))
        scored = losses.contrastive_score(df, "vec_id", "x_struct", "pattern", plain_sums=plain, tile=tile)
        return scored.withColumn("loss", round_to("loss", 5))


_contrastive("contrastive_score", "sum(exp(sim)) FILTER (WHERE pos_pair)", "sum(exp(sim)) FILTER (WHERE vec_id <> other)", False)
_contrastive("contrastive_score_plain_sums", "sum(CASE WHEN pos_pair THEN exp(sim) ELSE 1 END)", "sum(exp(sim))", True)
#: three batches of a third of all rows each, in tiles of 50
_contrastive("contrastive_large_batches", "sum(exp(sim)) FILTER (WHERE pos_pair)", "sum(exp(sim)) FILTER (WHERE vec_id <> other)", False, 50, _WHOLE)

