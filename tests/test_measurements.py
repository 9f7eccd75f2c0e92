"""Whole measurements of rooms against plain arithmetic."""

import math

import pytest

from planimetra.operators import measure

CORNERS = "room int, i int, corner_id string, inferred boolean, extension double, degrees double, rmse_a double, rmse_b double"
EDGES = "room int, i int, wall_id string, rmse double, confidence double"
LEVELS = "room int, floor_y double, ceiling_y double, floor_rmse double, ceiling_rmse double, floor_confidence double, ceiling_confidence double"
ROOMS = "room int, vertices array<struct<x double, z double>>, validity string, reasons array<string>, support double"


def test_one_room_and_odd_ones(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
    rooms = spark.createDataFrame([(1, square, "PROVISIONAL", ["inferred_corner"], 0.8), (2, square, "VALID", [], None), (3, square[:2], "INVALID", ["too_few_vertices"], 1.0), (4, None, "INVALID", [], None)], ROOMS)
    corners = spark.createDataFrame([(1, 0, "a", False, 0.0, 90.0, 0.01, 0.03), (1, 1, "b", True, 0.2, 60.0, 0.02, 0.02)], CORNERS)
    edges = spark.createDataFrame([(1, 0, "w", 0.03, 0.9)], EDGES)
    levels = spark.createDataFrame([(1, 0.1, 2.6, 0.01, 0.02, 0.9, 0.4), (2, 0.0, None, None, None, None, None)], LEVELS)
    got = {r.room: r for r in measure.assembled(rooms, corners, edges, levels, "room", 4000).collect()}
    one = got[1]
    sigma = [math.sqrt((0.01**2 + 0.03**2) + 1e-4), math.sqrt((2 * 0.02**2) / math.sin(math.radians(60)) ** 2 + 0.1**2 + 1e-4), *[math.sqrt(2 * 0.02**2 + 1e-4)] * 2]
    lengths, rmse, plane, inferred = [4, 3, 4, 3], [0.03, 0.025, 0.025, 0.025], [0.9, 0.7, 0.7, 0.7], [1, 1, 0, 0]
    confidence = []
    for k, w in enumerate(one.walls):
        half = 1.96 * math.sqrt(sigma[k] ** 2 + sigma[(k + 1) % 4] ** 2 + rmse[k] ** 2)
        confidence.append(plane[k] * max(0.5, 1 - rmse[k] / 0.15) * 0.85 ** inferred[k])
        assert (w.i, w.length.value) == (k, lengths[k]) and w.length.lower == pytest.approx(lengths[k] - half, abs=6e-4) and w.length.upper == pytest.approx(lengths[k] + half, abs=6e-4)
        assert w.length.confidence == pytest.approx(confidence[k], abs=6e-4) and w.has_inferred_corner == bool(inferred[k])
    assert [(w.wall_id, w.start_corner, w.end_corner) for w in one.walls] == [("w", "a", "b"), ("wall_02", "b", "corner_03"), ("wall_03", "corner_03", "corner_04"), ("wall_04", "corner_04", "a")]
    mean = sum(confidence) / 4
    assert (one.perimeter.value, one.floor_area.value, one.inferred_corners, one.wall_count) == (14.0, 12.0, 1, 4)
    assert one.perimeter.confidence == pytest.approx(mean * (1 - 0.15 / 4), abs=6e-4) and one.floor_area.confidence == pytest.approx(mean * 0.8 * (1 - 0.25 / 4) * 0.9, abs=6e-4)
    assert one.floor_area.lower < 12 < one.floor_area.upper and one.perimeter.lower < 14 < one.perimeter.upper and one.floor_area.interval == [one.floor_area.lower, one.floor_area.upper]
    half = 1.96 * math.hypot(0.01, 0.02)
    assert (one.ceiling_height.value, one.ceiling_status, one.status, one.reasons) == (2.5, "observed", "PROVISIONAL", ["inferred_corner"])
    assert one.ceiling_height.lower == pytest.approx(2.5 - half, abs=6e-4) and one.ceiling_height.confidence == 0.6
    assert got[2].ceiling_height is None and got[2].ceiling_status == "not_observed" and got[2].floor_area.confidence == pytest.approx(0.7 * (1 - 0.025 / 0.15), abs=6e-4)
    assert [(got[k].perimeter, got[k].floor_area, got[k].wall_count) for k in (3, 4)] == [(None, None, 2), (None, None, 0)]
