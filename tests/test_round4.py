"""Findings of round 4."""

import time

import numpy as np
import pytest

from planimetra.functions import clouds
from planimetra.operators import graph, measure


def test_equal_rooms_are_sampled_once(spark):
    """40,000 rooms of two kinds take 50,000 samples a kind and not a room; each room gets what it gets alone."""
    corners = lambda w: [(0.0, 0.0), (w, 0.0), (w, 3.0), (0.0, 3.0)]
    schema = "room long, vertices array<struct<x: double, z: double>>, sigma array<double>"
    rows = [(i, corners(4.0 + i % 2), [0.05, 0.02] if i % 2 else [0.05]) for i in range(40_000)]
    alone = [tuple(r)[1:] for i in (0, 1) for r in measure.monte_carlo(spark.createDataFrame(rows[i : i + 1], schema), "room", samples=50_000).collect()]
    start = time.monotonic()
    got = {r.room: tuple(r)[1:] for r in measure.monte_carlo(spark.createDataFrame(rows, schema), "room", samples=50_000).collect()}
    assert time.monotonic() - start < 30
    assert len(got) == 40_000 and all(v == alone[i % 2] for i, v in got.items())
    for i, w in enumerate((4.0, 5.0)):
        noise = np.random.RandomState(42).standard_normal((50_000, 4, 2)) * (np.array([0.05] + [0.02 if i else 0.05] * 3) / np.sqrt(2))[:, None]
        p = np.array(corners(w)) + noise
        q = np.roll(p, -1, axis=1)
        area = abs((p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(axis=1)) / 2
        assert got[i][:3] == pytest.approx((*np.percentile(area, [2.5, 97.5]), area.std()), abs=1e-9)


def test_cycles_shuffle_walks_once(spark):
    """Both halves of cycles come from one shuffle of walks, and results are not shuffled unless corners share two walls."""
    ring = [(0, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 0, "d"), (1, 3, "e")]
    schema = "capture string, source long, target long, wall_id string"
    single = graph.cycles(spark.createDataFrame([("k", *e) for e in ring], schema), "capture", 9)
    assert sorted(r.cycle for r in single.collect()) == [[0, 1, 2, 3], [0, 1, 3], [1, 2, 3]]
    assert single._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    double = graph.cycles(spark.createDataFrame([("k", *e) for e in [*ring, (0, 1, "f")]], schema), "capture", 9)
    assert sorted(r.cycle for r in double.collect()) == [[0, 1, 2, 3], [0, 1, 3], [1, 2, 3]]
    assert graph.cycles(spark.createDataFrame([("k", *e) for e in ring], schema), "capture", 2).count() == 0


def test_nearest_of_few_points_equals_that_by_cells(monkeypatch):
    rng = np.random.default_rng(1)
    points = np.round(rng.random((200, 3)), 1)
    queries = np.concatenate([np.round(rng.random((300, 3)) * 2, 1), points[:9]])
    few = clouds.Grid(points, 0.2).nearest(queries)
    monkeypatch.setattr(clouds, "_FEW", 0)
    cells = clouds.Grid(points, 0.2).nearest(queries)
    assert (few[0] == cells[0]).all() and (few[1] == cells[1]).all() and (few[0] >= 0).any() and (few[0] < 0).any()
