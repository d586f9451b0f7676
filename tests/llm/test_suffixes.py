import hashlib
import inspect
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import modalframe.llm.suffixes as suffixes
from modalframe.llm.suffixes import WIDTH, multikey_order, pieces_of, remove_repeats, repeated, runs_of, sliding_least


def brute(rows, width=WIDTH):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for d in data:
        for i in range(len(d) - width + 1):
            seen[d[i : i + width]] = seen.get(d[i : i + width], 0) + 1
    out = []
    for (doc, _), d in zip(rows, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


def run(df, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(df, **how).collect()), key=str)


def letters(rng, n):
    return "".join(rng.choice(list("abcdefghij klm"), n))


def made_rows(rng):
    long, other = letters(rng, 3000), letters(rng, 1500)
    rows = [(None, None), (1, ""), (2, "x" * 399), (3, "x" * 400), (4, "y" * 401), (5, "ab" * 450), (6, letters(rng, 900)), (6, letters(rng, 900))]
    rows += [(10, long), (11, long), (11, long), (12, letters(rng, 300) + long[700:1500] + letters(rng, 200)), (13, long[:399] + "!"), (14, "?" + long[100:500] + "?"), (15, long[100:499] + "?")]
    rows += [(20, other[:700] + letters(rng, 50) + other[650:]), (21, letters(rng, 10) + other[300:720]), (22, other[200:605] + letters(rng, 444) + other[1000:1410] + "é" * 300), (23, "é" * 250)]
    rows += [(30 + k, letters(rng, 60 + k) + long[1000 : 1400 + 7 * k] + letters(rng, 100)) for k in range(20)]
    changed = list(other)
    changed[750] = "#"
    return rows + [(60, "".join(changed)), (61, other[740:] + other[:760])]


@pytest.mark.parametrize("piece", [1 << 20, 700])
def test_against_brute_force(spark, rng, piece):
    rows = made_rows(rng)
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, place int, whole string")
    assert run(docs, piece=piece) == brute(rows)


def test_small_partitions_compare_across_boundaries(spark, rng, monkeypatch):
    monkeypatch.setattr(suffixes, "repeated", lambda records: repeated(records, per_part=15))
    rows = made_rows(rng)[:22]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_copies_do_not_multiply_records(spark, rng):
    """One text on most rows: each task makes records of two copies, and the result is that of all rows."""
    hot, other = letters(rng, 1300), letters(rng, 900)
    rows = [(k, hot) for k in range(240)] + [(300, other), (301, letters(rng, 30) + hot[200:700]), (302, other[100:600] + letters(rng, 50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()
    keyed = docs.select("text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(7)).alias("h2"))
    make = lambda d, h: suffixes.run_records(d, h, 1 << 20)
    one = suffixes._records(keyed.where(F.col("text") == hot).limit(1), make, []).count()
    hot_records = suffixes._records(keyed.where(F.col("text") == hot), make, []).count()
    assert one > 0 and hot_records == 2 * 4 * one
    assert run(docs) == brute(rows)
    docs.unpersist()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(docs).count() == 0


def test_whole_table(small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert run(small_docs) == brute(rows)


def test_repeated_with_one_hot_key(spark):
    rows = [(0, 5, 5, 1, 1, k) for k in range(500)] + [(0, 6, k, 1, 1, 1000 + k) for k in range(50)]
    table = spark.createDataFrame(rows, "kind int, t1 long, t2 long, h1 long, h2 long, place long")
    for size in (3, 10_000):
        hits = repeated(table, per_part=size)
        assert {r.place for r in hits.collect()} == set(range(500)) and hits.where("lead").count() >= 1


def test_multikey_order(rng):
    for n in (0, 1, 500):
        keys = [rng.integers(0, 4, n) for _ in range(4)]
        order = multikey_order(keys)
        assert [tuple(int(k[i]) for k in keys) for i in order] == sorted(tuple(int(x) for x in r) for r in zip(*keys))


def test_runs_cover_all_windows_and_match_in_copies(rng):
    data = np.frombuffer(letters(rng, 5000).encode(), np.uint8)
    lo, hi, anchor = runs_of(data)
    assert lo[0] == 0 and hi[-1] == len(data) - WIDTH and (lo[1:] == hi[:-1] + 1).all() and ((lo <= anchor + 16) & (anchor - hi <= WIDTH)).all()
    a, b, c = runs_of(data[1000:3000])
    inner = {(x + 1000, y + 1000, z + 1000) for x, y, z in zip(a[1:-1], b[1:-1], c[1:-1])}
    assert inner <= set(zip(lo, hi, anchor))
    x = rng.integers(0, 99, 57).astype(np.uint64)
    assert sliding_least(x, 10).tolist() == [x[i : i + 10].min() for i in range(48)]
    for n in (0, 399, 400, 1098, 1099, 1100, 5000):
        starts = [i for a, b in pieces_of(n, 700) for i in range(a, b - WIDTH + 1)]
        assert starts == list(range(max(0, n - WIDTH + 1)))


def test_one_character_over_and_over_is_worked_in_bounded_memory():
    data = np.full(600_000, ord("x"), np.uint8)  # every start is a run of its own
    piece, none = inspect.signature(remove_repeats).parameters["piece"].default, np.empty(0, np.int64)
    near = np.concatenate([runs_of(data[a:b])[0] + a for a, b in pieces_of(len(data), piece)])
    assert len(near) == len(data) - WIDTH + 1
    tracemalloc.start()
    rows = sum(len(found[0]) for found in suffixes.step_records(data, (1, 2), piece, none, none, near))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2 * len(near) and peak < 60e6
    assert suffixes.removed_bytes(data, piece, near, none, near, none, none).all()


def test_places_are_found_like_in_sets(rng):
    lo = np.cumsum(rng.integers(1, 90, 50))
    hi, anchor = lo + rng.integers(0, 70, 50), lo + rng.integers(0, 380, 50)
    expected = [(max(x, a), min(x + suffixes.STEP - 1, b), x) for a, b, c in zip(lo.tolist(), hi.tolist(), anchor.tolist()) for x in range(a - (a - c) % suffixes.STEP, b + 1, suffixes.STEP)]
    assert list(zip(*(x.tolist() for x in suffixes._steps(lo, hi, anchor)))) == expected
    places = [np.sort(rng.choice(60, k, replace=False)) for k in (30, 40, 10)]
    all_, near, lead = (set(x.tolist()) for x in places)
    assert suffixes._open(np.arange(60), *places).tolist() == [x in near and (x not in all_ or x in lead) for x in range(60)]
