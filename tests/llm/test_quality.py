import zlib

import numpy as np
import pytest

from modalframe.llm.quality import estimate_prior, feature_matrix, fit_arrays, keep_good, score_quality

SF = "/root/testdata/sf0.1"


def test_prior_and_risk_on_known_mixture(rng):
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    for share in (0.3, 0.6, 0.85):
        k = int(3000 * share)
        model = fit_arrays(good[:2000], np.vstack([good[1000 : 1000 + k], bad[: 3000 - k]]))
        assert abs(model.prior - share) < 0.07
        assert (model.score(good[3000:]) > 0.5).mean() > 0.95 and (model.score(bad[3000:]) < 0.5).mean() > 0.9


def test_prior_of_equal_samples(rng):
    x = rng.normal(0, 1, 3000)
    assert estimate_prior(x[:1500], x[1500:]) > 0.9


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 600 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    for r in rows[:50]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(x.doc_id for x in out.where("predicted = 1").collect())


def test_labels_of_the_other_class_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = docs.limit(100)
    a = {r.doc_id: r.score for r in score_quality(some, labels).collect()}
    b = {r.doc_id: r.score for r in score_quality(some, labels.where("quality = 1")).collect()}
    assert a == b


def test_defined_results_at_the_edges(spark):
    schema = "doc_id long, text string, score string"
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "some text here", "x"), (3, "w " * 100_000, "x"), (3, "w " * 100_000, "x")], schema)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    out = score_quality(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    none = score_quality(docs, labels.limit(0)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.7, 1)}
    assert score_quality(docs.limit(0), labels).count() == 0
    assert np.isfinite(feature_matrix([None, "", " \n", "é" * 10, "!" * 100_000])).all()
    assert feature_matrix([]).shape[1] == feature_matrix([""]).shape[1]


@pytest.mark.parametrize("text", ["Un Un Un Un Un Un", "A!! B!! C!!", "plain words of a line"])
def test_features_do_not_depend_on_layout(text):
    assert feature_matrix([text]).tolist() == feature_matrix(["z", text])[1:].tolist()
