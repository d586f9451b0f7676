from fractions import Fraction

import numpy as np
import pytest
from modalframe.llm.whitening import Scatter, cross_products, limbs, unlimb, whiten, whiten_digest

SCHEMA = "vec_id long, embedding array<double>, n string"


def brute(rows, components=32):
    """Exact rational sums, then eigh."""
    kept = [(i, v) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in x) * n - s[i] * s[j], n * n)) for j in range(d)] for i in range(d)])
    e, a = np.linalg.eigh(v)
    e, a = e[::-1][:components], a[:, ::-1][:, :components]
    keep = e > 1e-12 * e[0]
    e, a = e[keep], a[:, keep]
    out = {}
    for (i, _), r in zip(kept, x):
        dev = sum((n * c - t) ** 2 for c, t in zip(r, s))
        w = np.array([float(Fraction(n * c - t, n)) for c, t in zip(r, s)]) @ a / np.sqrt(e)
        out[i] = (n, dev, w, e / np.trace(v))
    return out


def compare(found, want):
    by = {}
    for r in found:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(want)
    signs = None
    for i, rows in by.items():
        n, dev, w, share = want[i]
        assert sorted(rows) == list(range(1, len(w) + 1))
        got = np.array([rows[k + 1].whitened for k in range(len(w))])
        if signs is None and np.abs(w).min() > 1e-6:
            signs = np.sign(got * w)
        assert all(r.n == n and r.deviation == dev and r.identity_error < 1e-8 for r in rows.values())
        assert np.allclose(np.abs(got), np.abs(w), atol=1e-7)
        if signs is not None:
            assert np.allclose(got * signs, w, atol=1e-7)
        assert np.allclose([rows[k + 1].explained for k in range(len(w))], share, rtol=1e-9)


def test_cross_products_are_exact(rng):
    for rows, dims, top in ((1, 3, 2), (64, 5, 1000), (777, 9, 2**40), (100, 4, 1)):
        y = rng.integers(0, top, (rows, dims))
        want = y.astype(object).T @ y.astype(object)
        assert (cross_products(y) == want).all()


def test_scatter_undoes_shifts(rng):
    x = rng.integers(-(2**50), 2**50, (5000, 3))
    one = Scatter(3)
    one.add(x[:4500])
    one.add(x[4500:])
    wide = x.astype(object)
    assert one.n == 5000 and (one.sums == wide.sum(axis=0)).all() and (one.cross == wide.T @ wide).all()


@pytest.mark.parametrize("value", [0, -1, 2**39, 2**40, -(2**100), 2**150 + 12345])
def test_limbs(value):
    assert unlimb(limbs(value)) == value


def test_against_brute_force(spark, rng):
    rows = [(k, (rng.normal(size=6) * [1, 2, 3, 4, 5, 6]).tolist(), "clash") for k in range(300)]
    rows += [(300 + k, rows[0][1], "copy") for k in range(100)]
    compare(whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect(), brute(rows))


def test_odd_rows(spark, rng):
    rows = [(k, rng.normal(size=4).tolist(), None) for k in range(30)]
    odd = [(100, None, "x"), (101, [], "x"), (102, [1.0, None, 2.0, 3.0], "x"), (103, [1.0, float("nan"), 2.0, 3.0], "x"), (104, [1.0, float("inf"), 2.0, 3.0], "x"), (105, [1.0, 2.0], "other length")]
    compare(whiten(spark.createDataFrame(rows + odd, SCHEMA)).collect(), brute(rows))
    assert whiten(spark.createDataFrame(odd[:5], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0], "")] * 3, SCHEMA)).count() == 0  # no spread, no component


def test_dependent_dimensions_and_huge_entries(spark, rng):
    base = rng.normal(size=(50, 2))
    rows = [(k, [float(np.floor(64 * a) / 64), float(np.floor(64 * a) / 64) * 2, float(b)], "") for k, (a, b) in enumerate(base)]
    found = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} == {1, 2}
    huge = rows + [(99, [1e300, 0.0, 0.0], "")]
    found = whiten_digest(spark.createDataFrame(huge, SCHEMA)).where("vec_id = 99 and component = 1").collect()[0]
    assert found.deviation is None and found.deviation_exact > 2**63


def test_query(spark):
    from modalframe.llm.catalog import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    compare(QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").collect(), brute([(r.vec_id, list(map(float, r.embedding)) if r.embedding is not None and None not in r.embedding else None, None) for r in rows]))
