"""Unions and differences of polygons against a raster and each other."""

import time

import numpy as np
import pytest

from planimetra.functions import overlay, shapes
from planimetra.operators import outlines


def star(rng, n):
    """A simple polygon of n corners around a random middle."""
    angle = 2 * np.pi * (np.arange(n) + rng.uniform(0, 0.4, n)) / n  # no gap of half a turn, which might make edges cross
    return rng.uniform(-1, 1, 2) + rng.uniform(0.5, 2.0, n)[:, None] * np.column_stack([np.cos(angle), np.sin(angle)])


def square(x, z, w, h=None):
    h = w if h is None else h
    return np.array([[x, z], [x + w, z], [x + w, z + h], [x, z + h]], float)


def covered(rings, p):
    return overlay.inside(p, overlay._edges(rings))


def test_random_polygons_equal_a_raster():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b, c = ([star(rng, int(rng.integers(3, 9)))] for _ in range(3))
        p = rng.uniform(-3, 3, (4000, 2))
        ia, ib, ic = (covered(r, p) for r in (a, b, c))
        for got, want in ((overlay.union([a, b, c]), ia | ib | ic), (overlay.difference(a, [b, c]), ia & ~ib & ~ic), (overlay.intersection([a, b]), ia & ib)):
            assert (covered(got, p) != want).sum() <= 2  # points on an edge
        whole, common = overlay.area(overlay.union([a, b])), overlay.area(overlay.intersection([a, b]))
        sizes = [abs(shapes.signed_area(r[0])) for r in (a, b)]
        assert whole + common == pytest.approx(sum(sizes), abs=1e-5) and common == pytest.approx(shapes.overlap(a[0], b[0]), abs=1e-5)
        assert overlay.area(overlay.difference(a, [b])) + common == pytest.approx(sizes[0], abs=1e-5)


def test_shared_walls_holes_and_corners():
    u = overlay.union([[square(0, 0, 2)], [square(2, 0, 2)], [square(2, 0, 2)]])
    assert len(u) == 1 and len(u[0]) == 4 and overlay.area(u) == pytest.approx(8)
    frame = overlay.union([[square(0, 0, 3, 1)], [square(0, 2, 3, 1)], [square(0, 0, 1, 3)], [square(2, 0, 1, 3)]])
    assert sorted(np.sign([shapes.signed_area(r) for r in frame])) == [-1, 1] and overlay.area(frame) == pytest.approx(8)
    assert overlay.area(overlay.union([frame, [square(1, 1, 1)]])) == pytest.approx(9) and len(overlay.union([frame, [square(1, 1, 1)]])) == 1
    touching = overlay.union([[square(0, 0, 1)], [square(1, 1, 1)]])
    assert [len(r) for r in touching] == [4, 4]
    inner = overlay.difference([square(0, 0, 4)], [[square(1, 1, 1)], [square(3, 0, 5)]])
    assert overlay.area(inner) == pytest.approx(16 - 1 - 4) and len(inner) == 2
    assert overlay.difference([square(0, 0, 1)], [[square(-1, -1, 3)]]) == [] and overlay.union([]) == [] and overlay.union([[np.zeros((2, 2))]]) == []
    assert overlay.area(overlay.union([[square(0, 0, 1)[::-1]], [square(0.5, 0, 1)]])) == pytest.approx(1.5)


def test_operators(spark):
    rows = [(1, "a", square(0, 0, 2)), (1, "b", np.insert(square(1, 0, 2), 1, [2, 0], axis=0)), (2, "c", square(5, 5, 1)), (3, "d", None)]
    table = spark.createDataFrame([(k, n, None if p is None else [tuple(map(float, v)) for v in p]) for k, n, p in rows], "place int, room string, vertices array<struct<x double, z double>>")
    got = {r.place: r for r in outlines.union(table, ["place"]).collect()}
    assert {k: round(r.area, 6) for k, r in got.items()} == {1: 6.0, 2: 1.0, 3: 0.0} and len(got[1].rings[0]) == 4 and got[3].rings == []
    left = {r.room: round(r.area, 6) for r in outlines.difference(table, table.filter("room in ('b', 'd')"), ["place"]).collect()}
    assert left == {"a": 2.0, "b": 0.0, "c": 1.0, "d": 0.0}


def test_areas_of_many_places_equal_rings_of_each(spark):
    rng, rows = np.random.default_rng(8), []
    for place in range(60):
        for room in range(place % 7 + 1):
            n = rng.integers(3, 7)
            turn = np.sort(rng.uniform(0, 2 * np.pi, n))
            ring = rng.integers(0, 6, 2) + np.column_stack([np.cos(turn), np.sin(turn)]) * 2 if place % 2 else square(*map(int, rng.integers(0, 6, 2)), *map(int, rng.integers(1, 4, 2)))
            rows.append((place, room, ring if room % 2 else ring[::-1]))
    rows += [(100, 1, None), (100, 2, square(0, 0, 2)), (101, 5, np.array([[0, 0], [np.nan, 1], [1, 1]])), (102, 1, square(0, 0, 3)), (102, 2, square(1, 1, 1))]
    table = spark.createDataFrame([(k, n, None if p is None else [tuple(map(float, v)) for v in p]) for k, n, p in rows], "place int, room int, vertices array<struct<x double, z double>>")
    got = {r.place: (r.area, r.beside_first) for r in outlines.covered(table, ["place"], "room").collect()}
    assert set(got) == {r[0] for r in rows}
    for place, found in got.items():
        rings = [[p] for k, _, p in rows if k == place and p is not None and np.isfinite(p).all()]
        whole = overlay.union(rings)
        first = [] if place >= 100 and place < 102 else rings[0]
        assert found == pytest.approx((overlay.area(whole), overlay.area(overlay.combined([whole, first], lambda x: x[0] & ~x[1]))), abs=1e-6)
    assert got[102] == pytest.approx((9, 0)) and got[100] == pytest.approx((4, 4)) and got[101] == (0, 0)


def test_a_thousand_places_take_seconds():
    x, z, w, h = (np.random.default_rng(k).integers(1, 20, 10_000).astype(float) for k in range(4))
    corner = np.stack([np.stack([x, x + w, x + w, x]), np.stack([z, z, z + h, z + h])], axis=2).transpose(1, 0, 2).reshape(-1, 2)
    ring = np.repeat(np.arange(10_000), 4)
    start = time.process_time()
    overlay.areas(*corner.T, ring, ring // 10, ring % 10 == 0, 1000)
    assert time.process_time() - start < 5
