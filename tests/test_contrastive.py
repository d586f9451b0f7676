"""Tiled contrastive sums: the same for every tile size, steep temperatures, hot batches, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from modalframe.operators import losses

SCHEMA = "id long, p string, v array<double>, batch_id long"


def by_hand(rows, temperature, plain=False):
    out = []
    for b in {r[3] for r in rows}:
        mine = [r for r in rows if r[3] == b and r[2] is not None]
        x = np.array([r[2] for r in mine], dtype=float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        sim = x @ x.T / temperature
        for i, r in enumerate(mine):
            same = np.array([o[1] == r[1] and j != i for j, o in enumerate(mine)])
            if not same.any():
                continue
            top, bottom = (np.where(same, sim[i], 0.0), sim[i]) if plain else (sim[i][same], np.delete(sim[i], i))
            out.append((b, r[0], int(same.sum()), np.logaddexp.reduce(bottom) - np.logaddexp.reduce(top)))
    return sorted(out, key=str)


def check(found, want):
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9, abs=1e-9)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    # one batch holds most rows; one pattern is rare, so that most of its tiles have no positive
    return [(i, "rare" if i in (3, 300) else str(i % 4), rng.normal(size=5).tolist(), 0 if i < 330 else 1 + i % 3) for i in range(400)]


@pytest.mark.parametrize("tile", [7, 64, 100_000])
@pytest.mark.parametrize("plain", [False, True])
def test_tiles_do_not_matter(spark, rows, tile, plain):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(losses.contrastive_score(df, "id", "v", "p", plain_sums=plain, tile=tile), by_hand(rows, 0.1, plain))


def test_steep_temperature_does_not_overflow(spark, rows):
    check(losses.contrastive_score(spark.createDataFrame(rows, SCHEMA), "id", "v", "p", temperature=1e-4, tile=40), by_hand(rows, 1e-4))


def test_groups_stay_bounded(spark, rows):
    placed = losses._tiled(spark.createDataFrame(rows, SCHEMA), "batch_id", "id", 40)
    assert placed.groupBy("batch_id", "_i", "_j").count().agg(F.max("count")).first()[0] <= 3 * 40
    parts = placed.filter("batch_id = 0 AND _role = 0").groupBy("id").count().distinct().collect()
    assert [r["count"] for r in placed.filter("batch_id = 0 AND _role <> 1").groupBy("id").count().select("count").distinct().collect()] == [9] and parts


def test_small_tiles_do_not_send_a_row_without_end(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    placed = losses._tiled(df, "batch_id", "id", 2).where("batch_id = 0").groupBy("id").count()
    assert placed.agg(F.max("count")).first()[0] == 2 * losses.FULL_PARTS - 1
    check(losses.contrastive_score(df, "id", "v", "p", tile=2), by_hand(rows, 0.1))


def test_odd_rows(spark):
    odd = [(1, "a", [1.0, 0.0], None), (2, "a", [0.5, 0.5], None), (2, "a", [0.0, 1.0], None), (3, "a", None, None), (4, None, [0.0, 0.0], 5), (5, None, [1.0, 1.0], 5), (6, "x", [1.0, 1.0], 6)]
    for tile in (1, 100):
        check(losses.contrastive_score(spark.createDataFrame(odd, SCHEMA), "id", "v", "p", tile=tile), by_hand(odd, 0.1))
    assert losses.contrastive_score(spark.createDataFrame([], SCHEMA), "id", "v", "p").collect() == []
