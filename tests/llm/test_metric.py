import numpy as np
import pandas as pd
import pytest

from modalframe.llm import metric
from modalframe.llm.common import UnionFind
from modalframe.llm.metric import _groups, near_vectors


def brute(rows, cosine=0.95):
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in good:
        for j in good:
            if i != j and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                a, b = a / 2.0 ** np.frexp(np.abs(a).max())[1], b / 2.0 ** np.frexp(np.abs(b).max())[1]
                link[i, j] = (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= cosine
    group = np.arange(n)
    while True:
        new = np.array([min([group[i], *group[link[i]]]) for i in range(n)])
        if (new == group).all():
            break
        group = new
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[group[i]] = min(least.get(group[i], d), d)
    return sorted(((d, int(link[i].sum()), None if d is None else least[group[i]], None if d is None else d == least[group[i]]) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows, **how):
    table = spark.createDataFrame([(d, v, 0, "x") for d, v in rows], "vec_id long, embedding array<float>, label int, node string")
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table, **how).collect()), key=str)


def cloud(rng, n, d=8, noise=0.18):
    centres = rng.normal(size=(6, d))
    out = [(int(k), np.float32(centres[k % 6] / np.linalg.norm(centres[k % 6]) + noise * rng.normal(size=d)).tolist()) for k in rng.permutation(n)]
    copies = [(int(1000 + k), list(out[k % 3][1])) for k in range(n // 3)]
    chain = [(2000 + k, [float(np.float32(np.cos(k * 0.2))), float(np.float32(np.sin(k * 0.2))), *[0.0] * (d - 2)]) for k in range(20)]
    return out + copies + chain


@pytest.mark.parametrize(("pivots", "tile"), [(None, 2048), (8, 16), (40, 7)])
def test_against_brute_force(spark, rng, pivots, tile):
    rows = cloud(rng, 150)
    assert run(spark, rows, pivots=pivots, tile=tile) == brute(rows)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, -0.0]), (9, [2.0, 0.0]), (9, [2.0, 0.0]),
        (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.1]), (11, [1.0, 0.4]), (12, [1.0, 0.4]), (13, [-1.0, 0.0]), (14, [1e-30, 0.0]), (15, [1e30, 1e29]), (None, None), (16, [3.0]),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_vectors(table).count() == 0
    assert run(spark, [(5, [1.0, 2.0])]) == [(5, 0, 5, True)]


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(table).collect()), key=str)
    assert got == brute(rows)


def test_groups_of_a_matrix():
    near = np.zeros((4, 5), bool)
    near[0, 1] = near[2, 1] = near[2, 3] = near[3, 4] = True
    assert [x.tolist() for x in _groups(near)] == [[0, -1, 0, 3], [-1, 0, -1, 0, 3]]


def test_a_tile_compares_slice_by_slice(monkeypatch):
    """Links and groups of a tile do not depend on the slices, and no more than a slice of residents is compared at a time."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(90, 6))
    v[30:60] = v[:30] + 0.05 * rng.normal(size=(30, 6))
    frame = pd.DataFrame({"node": np.arange(90), "v": list(v), "n": 1 + np.arange(90) % 3})
    found = []
    for size in (7, 1024):
        monkeypatch.setattr(metric, "SLICE", size)
        out = metric._tile(frame.iloc[:50], frame, 0.95)
        counts = out[out["other"].isna()]
        found.append(counts["near"].tolist())
        want = [int(frame["n"][metric.cosines(np.repeat(v[k : k + 1], 90, 0), v) >= 0.95].sum()) for k in range(50)]
        assert counts["near"].tolist() == want
        sets = UnionFind(90)
        for a, b in out[out["other"].notna()][["node", "other"]].astype(int).to_numpy().tolist():
            sets.union(a, b)
        whole = UnionFind(90)
        for k in range(50):
            for j in np.flatnonzero(metric.cosines(np.repeat(v[k : k + 1], 90, 0), v) >= 0.95).tolist():
                whole.union(k, j)
        assert [sets.find(k) for k in range(90)] == [whole.find(k) for k in range(90)]
    assert found[0] == found[1]


def test_memory_of_a_dense_tile_is_bounded():
    """All vectors link with all: the links held at a time are those of a piece of the tile."""
    import tracemalloc

    rng = np.random.default_rng(6)
    v = rng.normal(size=8) + 0.01 * rng.normal(size=(8192, 8))
    frame = pd.DataFrame({"node": np.arange(8192), "v": list(v), "n": 1})
    tracemalloc.start()
    out = metric._tile(frame.iloc[:1024], frame, 0.95)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (out["near"][out["other"].isna()] == 8192).all() and out["other"].notna().sum() >= 8191
    assert peak < 2e8  # 529 MB where a slice meets all others at once


def test_rows_handed_on_do_not_grow_with_the_cells(rng):
    """Vectors that reach into every cell are read as often as there are stripes, and a task hands on at most a few rows for each."""
    v = rng.normal(size=(1500, 64))
    pivots = {64: metric._unit(v[:400])}
    batch = pd.DataFrame({"node": np.arange(1500), "v": list(v), "n": 1})
    parts = list(metric._slices([batch], pivots, 0.3))
    assert sum(len(some) for _, some, *_ in parts) == 1500 and max(len(some) for _, some, *_ in parts) <= metric.SLICE
    home = np.concatenate([x[4] for x in parts])
    counts = {(64, int(c)): int((home == c).sum()) for c in np.unique(home)}
    plan, stripes = metric.plan_stripes(counts, tile=50)
    met = metric._stripes_of(64, home, np.arange(1500), plan)
    assert met.max() < stripes <= 12 and np.bincount(met).max() <= 250


def test_equal_hashes_of_other_vectors(spark, rng, monkeypatch):
    rows = cloud(rng, 60)
    monkeypatch.setattr(metric.F, "xxhash64", lambda *c: metric.F.lit(7).cast("long"))
    assert run(spark, rows) == brute(rows)
