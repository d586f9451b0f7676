"""The joint fit of logistic heads: against Spark ML, against the gradient, and on odd labels."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from modalframe.operators.heads import fit_heads, gradient_at

LABELS = {"a": "ya", "b": "yb", "c": "yc"}
SCHEMA = "id long, x array<double>, ya int, yb int, yc int, w double"


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        x = rng.normal(size=4) * (1, 100, 0.01, 0) + (0, 50, 0, 3)  # the last feature is constant
        draw = rng.uniform(size=2)
        p = 1 / (1 + np.exp(-(x[0] + x[1] / 100 - 0.3)))
        rows.append((i, x.tolist(), int(draw[0] < p), int(draw[1] < 0.05), int(x[0] > 0), float(rng.uniform(0.1, 3))))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("weight", [None, "w"])
def test_equals_separate_fits(table, weight):
    heads = fit_heads(table, "x", LABELS, weight=weight)
    rows = table.withColumn("f", array_to_vector("x"))
    for task, label in LABELS.items():
        lr = LogisticRegression(featuresCol="f", labelCol=label, regParam=0.01, maxIter=300, tol=1e-12)
        want = (lr.setWeightCol(weight) if weight else lr).fit(rows)
        assert heads[task].gradient_norm < 1e-9 and heads[task].scans < 15
        assert heads[task].coefficients == pytest.approx(want.coefficients.toArray().tolist(), rel=1e-4, abs=1e-5)
        assert heads[task].intercept == pytest.approx(want.intercept, rel=1e-4, abs=1e-5)


def test_gradient_vanishes_at_the_fit_only(table):
    heads = fit_heads(table, "x", LABELS)
    found = {r["task"]: r for r in gradient_at(table, "x", LABELS, heads).collect()}
    for task, label in LABELS.items():
        assert found[task]["gradient"] < 1e-8 and found[task]["n"] == 600
        assert found[task]["mean_probability"] == pytest.approx(table.agg(F.avg(label)).first()[0])
    moved = {t: h._replace(intercept=h.intercept + 0.1) for t, h in heads.items()}
    assert gradient_at(table, "x", LABELS, moved).agg(F.min("gradient")).first()[0] > 1e-3


def test_missing_labels_count_for_their_own_head_only(table):
    gaps = table.withColumn("yb", F.when(F.col("id") % 3 != 0, F.col("yb")))
    alone = fit_heads(table.filter("id % 3 != 0"), "x", {"b": "yb"}, reg=0.0)["b"]
    both = fit_heads(gaps, "x", LABELS, reg=0.0)
    assert both["b"].coefficients == pytest.approx(alone.coefficients, rel=1e-5, abs=1e-6)
    assert both["a"].coefficients == pytest.approx(fit_heads(table, "x", {"a": "ya"}, reg=0.0)["a"].coefficients, rel=1e-5, abs=1e-6)


def test_order_of_rows_and_tasks_does_not_matter(table):
    one, other = fit_heads(table, "x", LABELS), fit_heads(table.repartition(1).orderBy("id"), "x", dict(reversed(LABELS.items())))
    assert all(one[t].coefficients == pytest.approx(other[t].coefficients, rel=1e-7, abs=1e-9) for t in LABELS)


def test_one_class_no_weight_no_rows(spark, table):
    one = fit_heads(table.withColumn("ya", F.lit(1)).withColumn("yb", F.lit(0)).withColumn("yc", F.lit(None).cast("int")).limit(50).unionByName(table.limit(0)), "x", LABELS)
    row = table.limit(1).select(*[h.probability("x").alias(t) for t, h in one.items()]).first()
    assert (row["a"], row["b"]) == (1.0, 0.0) and np.isnan(row["c"])
    kept = fit_heads(table.withColumn("w", F.when(F.col("id") % 2 == 0, F.lit(1.0))), "x", {"a": "ya"}, weight="w")["a"]
    assert kept.coefficients == pytest.approx(fit_heads(table.filter("id % 2 = 0"), "x", {"a": "ya"})["a"].coefficients, rel=1e-6, abs=1e-8)
    with pytest.raises(ValueError):
        fit_heads(table.limit(0), "x", LABELS)


def test_steep_loss_is_stepped_back(spark):
    """Almost separable rows without a penalty of note: full Newton steps overshoot."""
    rows = [(i, [float(x)], y, y, y, 1.0) for i, (x, y) in enumerate([(-30, 0), (-1, 0), (1, 1), (2, 0), (3, 1), (500, 1)] * 4)]
    head = fit_heads(spark.createDataFrame(rows, SCHEMA), "x", {"a": "ya"}, reg=1e-6)["a"]
    assert head.gradient_norm < 1e-9 and np.isfinite(head.coefficients[0]) and head.coefficients[0] > 0
