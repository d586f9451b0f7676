import numpy as np
import pytest

from modalframe.llm.toxicity import _logistic, fit_arrays, fit_chain, plain_words, score_toxicity

SF = "/root/testdata/sf0.1"


def test_logistic_reaches_the_optimum(rng):
    x = np.c_[rng.normal(size=(500, 6)), np.ones(500)]
    y = (x @ rng.normal(size=7) + rng.logistic(size=500) > 0).astype(float)
    w = _logistic(x, y, 2.0, 500)
    grad = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + np.r_[np.full(6, 2.0), 0] * w
    assert np.abs(grad).max() < 0.05


def test_chain_uses_earlier_categories(rng):
    """The second category is the first plus noise that no feature shows: only the chain can carry it over."""
    x = rng.normal(size=(3000, 3))
    first = (x[:, 0] + 0.3 * rng.normal(size=3000) > 0).astype(int)
    second = (first & (x[:, 1] > 0)).astype(int)
    chain = fit_arrays([], x, {"a": first, "b": second, "c": np.zeros(3000)}, np.arange(3000) % 5)
    assert len(chain.models["b"]) == len(chain.models["a"]) + 1 and chain.models["b"][3] > 0.5
    p = chain.probabilities(x)
    assert ((p["a"] > 0.5) == first).mean() > 0.85 and ((p["b"] > 0.5) == second).mean() > 0.85 and (p["c"] == 0).all()


def test_held_out_detection(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, labels)
    assert out.columns == ["doc_id", "held_out", "p_junk", "p_toxic", "p_severe", "toxic"]
    rows = out.join(labels.withColumnRenamed("toxic", "truth"), "doc_id").where("held_out").collect()
    bad = [r for r in rows if r.truth == 1]
    assert sum(r.toxic for r in bad) / len(bad) > 0.75
    assert sum(r.toxic for r in rows if r.truth == 0) / len(rows) < 0.01


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "you idiot", "x"), (3, "w " * 50_000, "x"), (3, "w " * 50_000, "x")], "doc_id long, text string, p string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0), (3, 1, None), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for rows in (labels, labels.limit(0)):
        out = score_toxicity(docs, rows).collect()
        assert len(out) == 5 and all(0 <= v <= 1 for r in out for v in (r.p_junk, r.p_toxic, r.p_severe))
    assert {r.p_toxic for r in out} == {0.0}
    assert score_toxicity(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(("text", "words"), [(None, []), ("", []), ("Idiot!! é-x", [b"idiot", "é".encode(), b"x"])])
def test_words(text, words):
    assert plain_words(text) == words


def test_words_are_counted_over_all_labelled_documents(spark):
    """A word in one of a hundred documents: a fit on few rows does not see it, the counts over all rows do."""
    rows = [(d, "plain words here" + (" grumbleword" if d % 100 < 2 else ""), 1, int(d % 100 < 2)) for d in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    chain = fit_chain(table.select("doc_id", "text"), table.select("doc_id", "quality", "toxic"), fit_rows=20)
    assert b"grumbleword" in chain.words


def test_repeated_ids_stay_within_the_bound(spark):
    """One id on many rows: no more than the bounded number of rows reaches the driver, and the fit still works."""
    docs = spark.createDataFrame([(1, f"vile words {k}") for k in range(200)] + [(k, f"kind words {k}") for k in range(4, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1)] + [(k, 1, 0) for k in range(4, 40)], "doc_id long, quality int, toxic int")
    chain = fit_chain(docs, labels, fit_rows=50)
    assert set(chain.models) == {"junk", "toxic", "severe"}
