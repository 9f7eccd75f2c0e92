"""Operators on inputs with closed-form answers."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from planimetra.functions import labels, plan, uncertainty, vectors
from planimetra.operators import damage, evaluate, graph, measure, openings, points, rooms, rules, scale, spatial, structure, trajectory

VERTICES = "room_id string, vertices array<struct<x double, z double>>"


def polygons(spark, **named):
    return spark.createDataFrame([(k, [Row(x=float(x), z=float(z)) for x, z in v]) for k, v in named.items()], VERTICES)


def test_polygon_measures(spark):
    table = polygons(spark, rect=[(0, 0), (4, 0), (4, 3), (0, 3)], ell=[(0, 0), (6, 0), (6, 2), (3, 2), (3, 5), (0, 5)], bow=[(0, 0), (2, 2), (2, 0), (0, 2)], line=[(0, 0), (1, 1)])
    got = {r.room_id: r for r in measure.validated_polygon(measure.shape(table)).collect()}
    assert (got["rect"].area, got["rect"].perimeter, got["rect"].valid) == (12, 14, True)
    assert (got["ell"].area, got["ell"].perimeter, got["ell"].crossings) == (21, 22, 0)
    assert got["bow"].crossings == 1 and "self_intersecting" in got["bow"].errors
    assert "too_few_vertices" in got["line"].errors
    c = table.filter("room_id = 'rect'").select(plan.centroid(F.col("vertices")).alias("c")).first().c
    assert (c.x, c.z) == (2, 1.5)


def test_canonical_polygons_ignore_start_and_direction(spark):
    square = [(0, 0), (4, 0), (4, 3), (0, 3)]
    table = polygons(spark, a=square, b=square[2:] + square[:2], c=square[::-1], d=[(0, 0), (4, 0), (4, 3.1), (0, 3)])
    got = {r.room_id: r.k for r in table.select("room_id", plan.canonical(F.col("vertices")).cast("string").alias("k")).collect()}
    assert got["a"] == got["b"] == got["c"] != got["d"]


def test_monte_carlo_is_repeatable(spark):
    table = polygons(spark, room=[(0, 0), (5, 0), (5, 4), (0, 4)]).withColumn("sigma", F.array(*map(F.lit, (0.03, 0.02, 0.04, 0.025))))
    one, two = (measure.monte_carlo(table, "room_id").first() for _ in range(2))
    assert one == two and one.area_lower < 20 < one.area_upper and one.perimeter_lower < 18 < one.perimeter_upper


def test_corner_sigma_and_ceiling(spark):
    r = spark.range(1).select(*[uncertainty.corner_sigma(F.lit(0.02), F.lit(0.02), F.lit(1.0), F.lit(i), F.lit(0.2)).alias(n) for n, i in (("seen", False), ("inferred", True))]).first()
    assert r.inferred > r.seen
    room = spark.createDataFrame([(-1.25, 1.35, 0.012, 0.018), (None, 1.0, 0.01, 0.01)], "floor_y double, ceiling_y double, floor_rmse double, ceiling_rmse double")
    a, b = measure.ceiling_height(room).collect()
    assert abs(a.height - 2.6) < 1e-9 and abs(a.upper - a.height - 1.96 * math.hypot(0.012, 0.018)) < 1e-9 and b.height is None


def test_ray_and_opening(spark):
    pixel = spark.createDataFrame([(500.0, 500.0), (350.0, 500.0), (650.0, 500.0)], "u double, v double")
    eye = vectors.rotation(tuple(map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    hit = plan.pixel_hit((F.col("u"), F.col("v")), tuple(map(F.lit, (1000.0, 1000.0, 500.0, 500.0))), eye, tuple(map(F.lit, (0.0, 1.5, 0.0))), tuple(map(F.lit, (0.0, 0.0, 1.0, -3.0))))
    rows = [r.h for r in pixel.select(hit.alias("h")).collect()]
    assert (rows[0].x, rows[0].y, rows[0].z) == pytest.approx((0, 1.5, 3))
    assert abs(math.hypot(rows[1].x - rows[2].x, rows[1].z - rows[2].z) - 0.9) < 1e-9
    behind = plan.ray_hit(tuple(map(F.lit, (0.0, 0.0, 0.0))), tuple(map(F.lit, (0.0, 0.0, 1.0))), tuple(map(F.lit, (0.0, 0.0, 1.0, 3.0))))
    assert spark.range(1).select(behind.alias("h")).first().h is None


def test_rotation_and_relative_transforms(spark):
    half = math.sqrt(0.5)
    q, t = tuple(map(F.lit, (0.0, half, 0.0, half))), tuple(map(F.lit, (1.0, 2.0, 3.0)))
    row = spark.range(1).select(vectors.pose_matrix(q, t).alias("a"), F.struct(*[c.alias(n) for c, n in zip(vectors.transformed(vectors.rotation(q), t, tuple(map(F.lit, (1.0, 0.0, 0.0)))), "xyz")]).alias("p"))
    got = row.select("p", vectors.relative_transform(F.col("a"), F.col("a")).alias("i"), vectors.rotation_degrees(F.col("a")).alias("d")).first()
    assert (got.p.x, got.p.y, got.p.z) == pytest.approx((1, 2, 2)) and abs(got.d - 90) < 1e-6
    assert got.i == pytest.approx([1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    none = spark.range(1).select(F.array(*[c for r in vectors.rotation(tuple(map(F.lit, (0.0, 0.0, 0.0, 0.0)))) for c in r]).alias("m")).first().m
    assert none == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_folded_angles(spark):
    table = spark.createDataFrame([(0.0, 180.0), (10.0, 190.0), (0.0, 90.0), (15.0, 35.0)], "a double, b double")
    assert [r.d for r in table.select(plan.folded_degrees(F.col("a"), F.col("b")).alias("d")).collect()] == [0, 0, 90, 20]


def test_rooms(spark):
    square = lambda x, z, w, h: [(x, z), (x + w, z), (x + w, z + h), (x, z + h)]
    table = polygons(spark, room_01=square(0, 0, 4, 4), room_02=square(6, 0, 4, 4), connector=square(4, 1.5, 2, 1)).withColumn("p", F.lit(1)).withColumn("ord", F.when(F.col("room_id") == "room_01", 0).when(F.col("room_id") == "connector", 1).otherwise(2))
    doors = spark.createDataFrame([(1, "d1", 4.0, 2.0), (1, "d2", 6.0, 2.0)], "p int, opening_id string, x double, z double")
    edges = {(r.room_a, r.room_b, r.kind) for r in rooms.adjacency(table, doors, ["p"]).collect()}
    assert edges == {("connector", "room_01", "door"), ("connector", "room_02", "door")}
    assert rooms.overlaps(table, ["p"]).count() == 0
    two = polygons(spark, a=square(0, 0, 4, 4), b=square(1, 1, 4, 4)).withColumn("p", F.lit(1))
    r = rooms.overlaps(two, ["p"]).first()
    assert (r.overlap, r.ratio) == pytest.approx((9, 0.5625))
    far = polygons(spark, a=square(0, 0, 4, 4), b=square(15, 15, 3, 3)).withColumn("p", F.lit(1))
    none = doors.filter("false")
    assert rooms.adjacency(far.withColumn("ord", F.lit(0)), none, ["p"]).count() == 0
    assert rooms.property_document(measure.shape(far), ["p"], "lidar").first().total_area == 25
    walls = spark.createDataFrame([(1, math.cos(math.radians(d)), math.sin(math.radians(d))) for d in (30, 120, 210)], "p int, a double, c double")
    assert abs(rooms.dominant_orientation(walls, ["p"]).first().radians - math.radians(30)) < 1e-6


def test_moved_rooms(spark):
    table = polygons(spark, a=[(0, 0), (1, 0), (1, 1)], b=[(0, 0), (1, 0), (1, 1)], c=[(0, 0), (1, 0), (1, 1)])
    good = [1.0, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, -2, 0, 0, 0, 1]
    bad = [2.0, 0, 0, 5, 0, 1, 0, 0, 0, 0, 1, -2, 0, 0, 0, 1]
    moves = spark.createDataFrame([("a", [float(x) for x in good]), ("b", [float(x) for x in bad])], "room_id string, matrix array<double>")
    got = {r.room_id: r for r in rooms.moved_rooms(table, moves).collect()}
    assert (got["a"].vertices[0].x, got["a"].vertices[0].z, got["a"].reason) == (5, -2, None)
    assert got["b"].reason == "not_rigid" and got["b"].vertices is None and got["c"].reason == "no_transform"


def test_matching(spark):
    schema = "room string, type string, ord int, entity string, value double, angle double, centroid array<double>, surface string"
    make = lambda *rows: spark.createDataFrame([("r", "wall_length", i, *r, None) for i, r in enumerate(rows)], schema)
    status = lambda p, r: sorted((x.predicted or "", x.reference or "", x.status) for x in evaluate.match_features(p, r).collect())
    assert status(make(("p0", 4.0, 0.0, [2.0, 0.0]), ("p1", 3.0, 90.0, [4.0, 1.5])), make(("r0", 4.02, 0.0, [2.0, 0.0]), ("r1", 2.99, 90.0, [4.0, 1.5]))) == [("p0", "r0", "MATCHED"), ("p1", "r1", "MATCHED")]
    assert status(make(("p0", 4.0, 0.0, [2.0, 0.0])), make(("r0", 4.0, 0.0, [2.0, 0.0]), ("r1", 4.01, 0.0, [2.05, 0.0]))) == [("", "r0", "MISSED"), ("", "r1", "MISSED"), ("p0", "", "AMBIGUOUS")]
    assert status(make(("p0", 4.0, 45.0, [2.0, 0.0])), make(("r0", 4.0, 90.0, [2.0, 0.0]))) == [("", "r0", "MISSED"), ("p0", "", "PHANTOM")]


def test_evaluation_without_evidence(spark):
    rows = spark.createDataFrame([("lidar", "ceiling_height", 2.5, None)], "tier string, type string, predicted double, reference double")
    got = evaluate.gates(rows).collect()
    assert {r.result for r in got} == {"NOT_EVALUABLE"} and all(r.numerator is None and r.denominator is None for r in got)
    phantom = spark.createDataFrame([("lidar", "opening_width", 0.9, 0.9), ("lidar", "opening_width", 0.8, None), ("lidar", "opening_width", None, 0.7)], rows.schema)
    gate = evaluate.gates(phantom).filter("gate = 'opening_width'").first()
    assert (gate.numerator, gate.denominator, gate.result) == (1, 2, "FAIL")
    errors = spark.createDataFrame([(0.1,), (None,), (float("nan"),), (0.3,)], "absolute_error double")
    s = evaluate.error_statistics(errors).first()
    assert (s.n, s.mean, s["std"]) == (2, 0.2, 0.1)
    nothing = evaluate.error_statistics(errors.filter("false")).first()
    assert nothing.n == 0 and nothing["mean"] is None


def test_scale(spark):
    ratios = spark.createDataFrame([(1.8,)] * 40 + [(9.0,)] * 10, "ratio double")
    r = scale.robust_scale(ratios).first()
    assert abs(r.scale - 1.8) < 1e-9 and r.inlier_share >= 0.75 and r.status == "GOOD"
    few = scale.robust_scale(ratios.limit(5)).first()
    assert (few.scale, few.status) == (1.0, "FAILED")


def test_damage_extents_and_fusion(spark):
    grid = spark.createDataFrame([("m", i / 19, j / 19) for i in range(20) for j in range(20)], "mask string, u double, v double")
    assert abs(damage.area_extents(grid, "mask").first().area - 1.0) < 1e-9
    line = spark.createDataFrame([("m", 0.75 * (2 * i / 29 - 1) * 0.6, 0.75 * (2 * i / 29 - 1) * 0.8) for i in range(30)], "mask string, u double, v double")
    assert abs(damage.linear_extents(line, "mask").first().length - 1.5) < 1e-6
    schema = "capture_id int, surface_id string, ord int, observation_id string, damage_class string, confidence double, x double, y double, z double, angle double, area double, lower double, upper double, status string"
    near = [(1, "wall_01", i, f"o{i}", "water_stain", 0.9, 1.0 + 0.04 * i, 1.0, 0.0, a, v, v - 0.1, v + 0.1, "ACCEPTED") for i, (a, v) in enumerate([(30.0, 0.50), (10.0, 0.54), (20.0, 0.48)])]
    regions = damage.fused(damage.clusters(spark.createDataFrame(near, schema)), ["capture_id", "surface_id", "cluster"]).collect()
    assert len(regions) == 1 and regions[0].area == 0.507 and regions[0].best_observation == "o1"
    apart = [near[0], (*near[1][:6], 2.6, *near[1][7:])]
    assert damage.fused(damage.clusters(spark.createDataFrame(apart, schema)), ["capture_id", "surface_id", "cluster"]).count() == 2


def test_rules_and_scope(spark):
    regions = spark.createDataFrame(
        [("d1", "water_stain", "wall", 0.5, 0.5, None, "ACCEPTED"), ("d2", "mold", "ceiling", 0.1, 0.1, None, "ACCEPTED"), ("d3", "crack_structural", "wall", 0.3, None, 0.3, "PROVISIONAL"), ("d4", "water_stain", "floor", None, None, None, "ACCEPTED")],
        "damage_id string, damage_class string, surface_type string, extent double, area double, length double, status string",
    )
    told = rules.flags(regions, rules.rule_table(spark)).collect()
    fired = {(r.damage_id, r.rule_id) for r in told}
    assert fired == {("d1", "RULE_WATER_STAIN_WALL_CAVITY"), ("d2", "RULE_MOLD_DISCOLORATION_SAMPLING"), ("d3", "RULE_CRACK_STRUCTURAL_SHEAR")}
    said = {r.damage_id: r.evidence for r in told}
    assert said["d1"] == "Observed water_stain on wall (d1) spanning 0.50 m²" and said["d3"] == "Observed crack_structural on wall (d3) spanning 0.30 m"
    always = spark.createDataFrame([("R", ["water_stain"], [], 0.0, "i", "r", 0.5)], rules.rule_table(spark).schema)
    assert {r.damage_id: r.evidence for r in rules.flags(regions, always).collect()}["d4"] == "Observed water_stain on floor (d4)"
    items = {r.line_item_id: r for r in rules.scope(regions).collect()}
    assert items["d4_item_03_remed"].quantity is None and items["d3_item_04_finish"].unit == "linear_m"
    assert "d2_item_02_contain" in items and "d1_item_02_contain" not in items
    whole = rules.with_children(regions, rules.flags(regions, rules.rule_table(spark)), rules.scope(regions))
    assert {r.damage_id: len(r.rules) for r in whole.collect()} == {"d1": 1, "d2": 1, "d3": 1, "d4": 0}


def test_cycles_and_components(spark):
    edges = spark.createDataFrame([(1, 0, 1, "a"), (1, 1, 2, "b"), (1, 2, 3, "c"), (1, 3, 0, "d"), (1, 0, 2, "e")], "capture int, source int, target int, wall_id string")
    got = sorted(tuple(r.cycle) for r in graph.cycles(edges, "capture").collect())
    assert got == [(0, 1, 2), (0, 1, 2, 3), (0, 2, 3)]
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    assert dict(map(tuple, graph.components(pairs).collect())) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_distance_join_meets_every_pair_once(spark):
    rows = [(i, (i * 37 % 101) / 10, (i * 53 % 97) / 10, (i * 29 % 89) / 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double")
    got = [(r.a.id, r.b.id) for r in spatial.within(df, df, ["x", "y", "z"], 1.3, extra=F.col("a.id") < F.col("b.id")).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and math.dist(a[1:], b[1:]) <= 1.3}
    assert len(got) == len(set(got)) and set(got) == want


def test_pixels_labels_and_support(spark):
    table = spark.createDataFrame([(10, 20, 0), (10, 20, 90), (10, 20, 180), (10, 20, 270), (10, 20, 45)], "u int, v int, d int")
    got = [r.p for r in table.select(labels.rotated_pixel(F.col("u"), F.col("v"), F.lit(100), F.lit(50), F.col("d")).alias("p")).collect()]
    assert [(p.u, p.v) if p else None for p in got] == [(10, 20), (29, 10), (89, 29), (20, 89), None]
    cloud = spark.createDataFrame([(i, i % 2, 0.01 * (i % 3), 0.0, 0.0) for i in range(10)], "point_id int, view_id int, x double, y double, z double")
    assert {r.status for r in points.supported(cloud).collect()} == {"PROVISIONAL"} and points.supported(cloud).count() == 10
    assert {r.status for r in points.supported(cloud, least_points=5).collect()} == {"OK"}


def test_keyframes_and_planes(spark):
    poses = spark.createDataFrame([(1, i, float(i), 0.1 * i, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(40)], "t int, frame int, ts_s double, x double, y double, z double, qx double, qy double, qz double, qw double")
    assert [r.frame for r in trajectory.keyframes(poses, "t").orderBy("frame").collect()][:4] == [0, 5, 10, 15]
    flat = [(1, (i * 7 % 50) / 10, 0.0, (i * 11 % 40) / 10) for i in range(200)] + [(1, 2.0, (i * 3 % 25) / 10, (i * 11 % 40) / 10) for i in range(150)]
    found = structure.planes_by_ransac(spark.createDataFrame(flat, "capture int, x double, y double, z double"), "capture", most=2).orderBy("plane_id").collect()
    assert [r.inliers >= 140 for r in found] == [True, True] and abs(found[0].b) > 0.99 and abs(found[1].a) > 0.99


def test_openings_choose_the_nearer_wall(spark):
    one = spark.createDataFrame([(1, "o", 0.0, 3.0, 0.9, 0.85)], "c int, opening_id string, x double, z double, width double, score double")
    walls = spark.createDataFrame([(1, "wall_A", 0, -2.0, 3.0, 2.0, 3.0), (1, "wall_B", 1, 5.0, -2.0, 5.0, 2.0)], "c int, wall_id string, ord int, x1 double, z1 double, x2 double, z2 double")
    assert openings.to_walls(one, walls, ["c"]).first().wall_id == "wall_A"


def test_labels_of_degenerate_and_upside_down_segments(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0, 1.0, 1.0), (1, 0.0, 0.0, -2.0, 0.0), (2, 0.0, 0.0, 0.0, -3.0), (3, 4.0, 0.0, 0.0, -4.0)], "i long, x1 double, y1 double, x2 double, y2 double")
    ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    got = rows.select("i", plan.label_position(*ends).alias("p"), plan.label_angle(*ends).alias("a")).orderBy("i").collect()
    assert [round(r.a, 6) for r in got] == [0.0, 0.0, -90.0, 45.0]
    assert (got[0].p.x, got[0].p.y) == (1.0, 1.0) and (got[1].p.x, round(got[1].p.y, 6)) == (-1.0, -0.15)


def test_capture_ids_that_leave_their_folder(spark):
    names = [("room-1", True), ("", False), (None, False), ("..", False), ("a/b", False), ("a\\b", False), ("a.b", True)]
    got = spark.createDataFrame(names, "name string, safe boolean").select("safe", labels.safe_capture_id(F.col("name")).alias("got")).collect()
    assert all(r.safe == r.got for r in got)


def test_first_frames_and_missing_poses(spark):
    frames = spark.createDataFrame([("a", 3), ("a", 1), ("a", 2), ("b", 9)], "capture string, frame long")
    assert sorted(map(tuple, trajectory.first_frames(frames, "capture", 2, "frame").collect())) == [("a", 1), ("a", 2), ("b", 9)]
    assert trajectory.first_frames(frames, "capture", 0, "frame").count() == 4
    images = spark.createDataFrame([("x",), ("y",), ("z",)], "image string")
    poses = spark.createDataFrame([("x", [1.0, 2.0, 3.0], [0.1, 0.2, 0.3, 0.4]), ("y", None, [1.0, 0.0, 0.0, 0.0])], "image string, position array<double>, quaternion_wxyz array<double>")
    got = {r.image: (r.position, r.quaternion) for r in trajectory.with_poses(images, poses).collect()}
    assert got == {"x": ([1.0, 2.0, 3.0], [0.2, 0.3, 0.4, 0.1]), "y": (None, None), "z": (None, None)}
    solved = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0]), (3, None), (4, [])], "i long, t_vec array<double>")
    assert {r.i: (r.x, r.reason) for r in trajectory.camera_poses(solved).collect()} == {1: (1.0, None), 2: (None, "no_camera_centre"), 3: (None, "no_camera_centre"), 4: (None, "no_camera_centre")}
