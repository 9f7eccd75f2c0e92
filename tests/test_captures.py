"""Whole runs on captures that are built here, so that the right answer is known."""

import math

from pyspark.sql import Row
from pyspark.sql import functions as F

from planimetra.operators import rooms
from planimetra.plans import captures


def grid(n, m, f):
    return [f((i + 0.5) / n, (j + 0.5) / m) for i in range(n) for j in range(m)]


def box_room(w=4.0, d=3.0, h=2.6, step=0.04):
    n, m, k = (round(x / step) for x in (w, d, h))
    out = []
    for y in (0.0, h):
        out += grid(n, m, lambda a, b: (a * w, y, b * d))
    for x in (0.0, w):
        out += grid(k, m, lambda a, b: (x, a * h, b * d))
    for z in (0.0, d):
        out += grid(k, n, lambda a, b: (b * w, a * h, z))
    return out


def test_structure_and_footprint_of_a_box(spark):
    points = [(1, i, *map(float, p)) for i, p in enumerate(box_room())]
    cloud = spark.createDataFrame(points, "capture_id int, point_id long, x double, y double, z double").repartition(8)
    found = captures.structure_of(cloud, radius=0.09, tries=60)
    levels = found["levels"].first()
    assert abs(levels.height - 2.6) < 0.02 and levels.reason is None
    walls = found["walls"]
    rows = walls.collect()
    assert len(rows) == 4 and all(abs(r.height - 2.56) < 0.1 for r in rows)
    again = spark.createDataFrame(rows, walls.schema)
    room = captures.footprint(again).first()
    assert room.valid and abs(room.area - 12) < 0.2 and abs(room.perimeter - 14) < 0.2
    open_ = captures.footprint(again.filter(F.col("wall_id") != rows[0].wall_id)).first()
    assert open_.vertices is None and not open_.valid


def test_reconstruction_of_a_wall(spark):
    pixels = [(1, f, u, v, 2000, 2 if u % 10 else 1, 100.0, 100.0, 50.0, 50.0) for f in (0, 1) for u in range(0, 100, 2) for v in range(0, 100, 2)]
    pixels += [(1, 0, 50, 50, 6000, 2, 100.0, 100.0, 50.0, 50.0)]
    depth = spark.createDataFrame(pixels, "capture_id int, frame int, u int, v int, depth_mm int, confidence int, fx double, fy double, cx double, cy double")
    turn = math.sqrt(0.5)
    poses = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (1, 1, 1.0, 0.0, 0.0, 0.5, 0.0, turn, 0.0, turn)], "capture_id int, frame int, ts_s double, x double, y double, z double, qx double, qy double, qz double, qw double")
    got = captures.reconstruction(depth, poses, voxel=0.05, neighbours=4)
    assert tuple(got["funnel"].select("pixels", "confident", "in_range").first()) == (5001, 4001, 4000)
    cloud = got["cloud"].collect()
    straight, turned = [p for p in cloud if abs(p.z - 2) < 1e-6], [p for p in cloud if abs(p.x - 2) < 1e-6]
    assert len(straight) > 1000 and len(turned) > 1000 and len(cloud) == len({*straight, *turned})
    assert abs(got["trajectory"].first().path_length - 0.5) < 1e-9
    assert abs(got["bounds"].first().y_span - 1.96) < 0.05


def test_openings_of_a_wall(spark):
    walls = spark.createDataFrame([(1, 1, 1, 0.0, 3.0, 4.0, 3.0), (1, 2, 2, 4.0, 0.0, 4.0, 3.0)], "capture_id int, wall_id int, ord int, x1 double, z1 double, x2 double, z2 double")
    row = lambda i, x, w, label="door", s=120.0: (1, i, x, 2.9, w, 0.85, label, 0.9, s, 2.0, False, False, 100.0, 50.0, 300.0, 400.0, 640, 480, True)
    seen = spark.createDataFrame([row(1, 1.0, 0.90), row(2, 1.1, 0.92), row(3, 1.05, 0.88), row(4, 3.0, 0.9), row(5, 1.0, 1.2, "window"), row(6, 1.0, 0.9, s=20.0), row(7, 1.0, 9.0)], "capture_id int, observation_id long, x double, z double, width double, score double, label string, cos double, sharpness double, distance double, left_clipped boolean, right_clipped boolean, x1 double, y1 double, x2 double, y2 double, image_width int, image_height int, depth_step boolean")
    wide = row(8, 1.0, 0.9)[:12] + (0.0, 0.0, 640.0, 480.0, 640, 480, True)
    seen = seen.unionByName(spark.createDataFrame([wide], seen.schema))
    got = {(r.wall_id, r.label, r.cluster): r for r in captures.openings_of(seen, walls).collect()}
    door = got[1, "door", 0]
    assert (door.frames, door.high_quality, door.status) == (4, 3, "accepted") and abs(door.width - 0.9) < 1e-9
    assert {k[:2] for k in got} == {(1, "door"), (1, "window")} and len(got) == 3


def test_property_documents(spark):
    square = lambda x, z, w, h: [Row(x=float(x), z=float(z)), Row(x=float(x + w), z=float(z)), Row(x=float(x + w), z=float(z + h)), Row(x=float(x), z=float(z + h))]
    table = spark.createDataFrame([(1, "room_01", 0, square(0, 0, 4, 4)), (1, "connector", 1, square(4, 1.5, 2, 1)), (1, "room_02", 2, square(6, 0, 4, 4)), (2, "a", 0, square(0, 0, 4, 4)), (2, "b", 1, square(1, 1, 4, 4))], "property_id int, room_id string, ord int, vertices array<struct<x double, z double>>")
    doors = spark.createDataFrame([(1, "d1", 4.0, 2.0), (1, "d2", 6.0, 2.0)], "property_id int, opening_id string, x double, z double")
    got = captures.property_of(table, doors)
    document = {r.property_id: r for r in got["document"].collect()}
    assert (document[1].n_rooms, document[1].total_area, document[1].valid) == (3, 34, True)
    assert (document[2].overlaps, document[2].valid) == (1, False)
    assert got["adjacency"].filter("property_id = 1").count() == 2


def test_regions_of_a_trajectory(spark):
    angle = 0.3
    turn = lambda u, v: (u * math.cos(angle) - v * math.sin(angle), u * math.sin(angle) + v * math.cos(angle))
    places = [(u + i % 5 * 0.1, v + i // 5 * 0.1) for u in (1, 8) for v in (1, 9) for i in range(20)] + [(0.5 + i * 0.2, 5.0) for i in range(40)]
    poses = spark.createDataFrame([(1, i, *turn(u, v)) for i, (u, v) in enumerate(places)] + [(2, i, 0.1 * i, 0.0) for i in range(12)], "capture_id int, frame int, x double, z double")
    walls = [(4.5, 2.0, 1, 0), (4.5, 8.0, 1, 0), (2.0, 4.0, 0, 1), (6.0, 6.0, 0, 1)]
    walls = spark.createDataFrame([(1, i, *turn(u, v), *turn(a, c)) for i, (u, v, a, c) in enumerate(walls)], "capture_id int, wall_id int, x double, z double, a double, c double")
    got = {(r.capture_id, r.room_id): r for r in rooms.regions(poses, walls, ["capture_id"]).collect()}
    assert set(got) == {(1, f"room_0{i}") for i in range(1, 5)} | {(1, "connector_01"), (2, "room_01")}
    assert got[1, "connector_01"].frames == 40 and got[1, "connector_01"].is_connector and len(got[1, "connector_01"].parts) == 2
    assert [got[1, f"room_0{i}"].frames for i in range(1, 5)] == [20] * 4
    # the cells fill the box of the trajectory and its margin
    spans = [max(p[i] for p in places) - min(p[i] for p in places) + 0.8 for i in (0, 1)]
    assert abs(sum(r.area for k, r in got.items() if k[0] == 1) - spans[0] * spans[1]) < 1e-6


def test_benchmark_report(spark):
    rows = [("lidar", "r", f"e{i}", "ceiling_height", 2.5, 2.51, 2.4, 2.6) for i in range(3)] + [("video", "r", "v", "wall_length", 3.0, 3.5, 2.9, 3.1), ("photo", "r", "p", "wall_length", 3.0, None, None, None)]
    table = spark.createDataFrame(rows, "tier string, room_id string, entity string, type string, predicted double, reference double, lower double, upper double")
    other = spark.createDataFrame([("r", "e0", "ceiling_height", 2.6), ("r", "v", "wall_length", 3.4)], "room_id string, entity string, type string, incumbent double")
    got = {(r.section, r.name): r for r in captures.benchmark(table, other).collect()}
    assert got["gate", "ceiling_height"].result == "PASS" and got["gate", "video_walls"].result == "FAIL" and got["gate", "photo_walls"].result == "NOT_EVALUABLE"
    assert (got["intervals", "lidar"].value, got["intervals", "video"].value) == (1.0, 0.0) and got["intervals", "photo"].result == "NOT_EVALUABLE"
    assert (got["incumbent", "lidar"].numerator, got["incumbent", "video"].numerator) == (1, 0)
    assert abs(got["accuracy", "lidar.ceiling_height"].value - 0.01) < 1e-9
