"""Order-dependent and geometric operators against plain loops or planted answers, and small functions by hand."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from planimetra.functions import labels, plan, shapes, uncertainty, vectors
from planimetra.operators import damage, evaluate, graph, imaging, measure, openings, points, rooms, scale, structure, trajectory
from planimetra.plans import catalog
from planimetra.plans.bindings import view
from planimetra.sources import readers, writers

SF = "/root/testdata/sf0.001"


def groups(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return out


# ---- queries without SQL --------------------------------------------------------------------------------------------


def test_i7_opening_clusters(spark):
    want = set()
    for (surface, kind), rows in groups(view(spark, SF, "observations").collect(), "surface_id", "damage_class").items():
        centres = []
        for r in sorted(rows, key=lambda r: r.observation_id):
            p = (r.u / 40, r.v)
            near = [(math.hypot(x / n - p[0], y / n - p[1]), k) for k, (x, y, n) in enumerate(centres)]
            k = min(near)[1] if near and min(near)[0] < 0.75 else len(centres)
            x, y, n = centres[k] if k < len(centres) else (0.0, 0.0, 0)
            centres[k : k + 1] = [(x + p[0], y + p[1], n + 1)]
            want.add((surface, kind, r.observation_id, k))
    assert {tuple(r) for r in catalog.QUERIES["i7_opening_clusters"](spark, SF).collect()} == want


def test_i8_damage_clusters(spark):
    want = []
    for (capture, surface), rows in groups(view(spark, SF, "observations").collect(), "capture_id", "surface_id").items():
        left = sorted(rows, key=lambda r: r.observation_id)
        while left:
            seed = left[0]
            near = [r for r in left if math.hypot((r.u - seed.u) / 40, r.v - seed.v) <= 0.35]
            left = [r for r in left if r not in near]
            votes = defaultdict(float)
            for r in near:
                votes[r.damage_class] += r.confidence
            best = min(near, key=lambda r: (r.angle, r.observation_id))
            want.append((capture, surface, len(near), best.observation_id, round(sum(votes.values()) / len(near), 2)))
            assert seed in near
    got = catalog.QUERIES["i8_damage_clusters"](spark, SF).collect()
    assert sorted((r.capture_id, r.surface_id, r.n_observations, r.best_observation) for r in got) == sorted(w[:4] for w in want)
    assert sum(r.confidence for r in got) == pytest.approx(sum(w[4] for w in want), rel=0.01)


def test_a16_area_extents(spark):
    got = {r.surface_id: r.area for r in catalog.QUERIES["a16_area_extents"](spark, SF).collect()}
    for (surface,), rows in groups(view(spark, SF, "observations").collect(), "surface_id").items():
        p = sorted({(r.u, r.v) for r in rows})
        area = 0.0  # sides of the hull have all points on their left
        for a in p:
            for b in p:
                if a != b and all((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) >= 0 for c in p):
                    area += (a[0] * b[1] - a[1] * b[0]) / 2
        if len(p) > 2 and area > 1e-9:
            assert got[surface] == pytest.approx(area, abs=1e-3)
    assert len(got) == len({r.surface_id for r in view(spark, SF, "observations").collect()})


def test_i5_merged_walls(spark):
    rows = view(spark, SF, "walls").collect() + view(spark, "/root/testdata/sf0.01", "walls").collect()
    rows = list({r.wall_id: r for r in rows}.values())
    table = spark.createDataFrame([(r.capture_id, r.wall_id, r.a, r.b, r.c, r.d, r.inliers) for r in rows], "capture_id long, wall_id long, a double, b double, c double, d double, inliers long")
    want = {}
    for _, own in groups(rows, "capture_id").items():
        seeds = []
        for r in sorted(own, key=lambda r: (-r.inliers, r.wall_id)):
            for s in seeds:
                dot = s.a * r.a + s.b * r.b + s.c * r.c
                if abs(dot) >= math.cos(math.radians(12)) and abs(s.d - math.copysign(1, dot) * r.d) <= 0.18:
                    want[r.wall_id] = s.wall_id
                    break
            else:
                seeds.append(r)
                want[r.wall_id] = r.wall_id
    assert {r.wall_id: r.merged_into for r in structure.merged_walls(table, "capture_id").collect()} == want


def test_i6_merged_lines(spark):
    rows = [(1, 1, 0.0, 1.0, -2.0, 0.0, 2.0, 3000), (1, 2, 0.0, -1.0, 2.1, -4.0, -2.2, 1000), (1, 3, 0.0, 1.0, -2.0, 9.0, 10.0, 500), (1, 4, 1.0, 0.0, -2.0, 0.0, 2.0, 400), (2, 5, 0.0, 1.0, -2.0, 0.0, 2.0, 10)]
    got = {r.wall_id: r for r in imaging.merged_lines(spark.createDataFrame(rows, "capture_id int, wall_id int, a double, b double, c double, start double, end double, inliers long"), "capture_id").collect()}
    assert set(got) == {1, 3, 4, 5} and got[1].merged == 2 and got[1].inliers == 4000
    assert (got[1].start, got[1].end, got[1].c) == (0.0, 4.0, pytest.approx(-2.025))


def test_i4_planted_planes(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(-2, 2, (1200, 3))
    p[:600, 1] = 0.5 + rng.normal(0, 0.004, 600)
    p[600:1000, 0] = -1 + rng.normal(0, 0.004, 400)
    table = spark.createDataFrame([(k, *map(float, x)) for k in (1, 2) for x in p], "view_id int, x double, y double, z double")
    got = structure.planes_by_ransac(table, "view_id", most=3, least=150, distance=0.03).collect()
    assert len(got) == 4
    again = structure.planes_by_ransac(table.repartition(7, "x"), "view_id", most=3, least=150, distance=0.03).collect()
    assert sorted(again) == sorted(got)  # bit for bit, however the points are spread
    one = sorted(r for r in got if r.view_id == 1)
    assert [int(np.argmax(np.abs(r[2:5]))) for r in one] == [1, 0] and abs(one[0].d + 0.5) < 0.002 and abs(one[1].d - 1) < 0.002 and one[0].inliers >= 600
    for r in one:
        near = p[np.abs(p @ np.array(r[2:5]) + r.d) <= 0.03]
        assert abs(len(near) - r.inliers) < 60 and r.rmse < 0.02
    first, second = (next(r for r in got if r.view_id == 1 and r.plane_id == i) for i in (0, 1))
    assert (first.b, first.d) == (pytest.approx(1, abs=0.01), pytest.approx(-0.5, abs=0.02)) and 590 <= first.inliers <= 640
    assert (second.a, second.d) == (pytest.approx(1, abs=0.01), pytest.approx(1, abs=0.02)) and second.rmse < 0.02


def test_i4_few_odd_and_many_planes(spark):
    schema = "view_id int, x double, y double, z double"
    assert structure.planes_by_ransac(spark.createDataFrame([], schema), "view_id").count() == 0
    odd = [(1, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (1, 0.0, 0.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)]
    assert structure.planes_by_ransac(spark.createDataFrame(odd, schema), "view_id", least=1).count() == 0
    # nine points make three planes at most; the fourth point on none of them stays
    flat = [(1, float(x), float(y), 0.0) for x in range(4) for y in range(4)] + [(1, float(x), 9.0, float(z)) for x in range(3) for z in range(1, 4)]
    got = structure.planes_by_ransac(spark.createDataFrame(flat, schema), "view_id", least=9, tries=400).orderBy("plane_id").collect()
    assert [(r.plane_id, r.inliers) for r in got] == [(0, 16), (1, 9)] and got[0].c == pytest.approx(1) and got[1].b == pytest.approx(1) and got[1].rmse < 1e-6


def test_i12_normals(spark):
    rows = [(i, i % 20 * 0.1, 0.3 * (i % 20 * 0.1), i // 20 * 0.1) for i in range(400)]
    got = imaging.normals(spark.createDataFrame([(i, *map(float, x)) for i, *x in rows], "point_id long, x double, y double, z double"), "point_id", 0.25, 12).collect()
    up = np.array([-0.3, 1, 0]) / math.hypot(0.3, 1)
    assert len(got) == 400 and all(abs(abs(np.dot((r.nx, r.ny, r.nz), up)) - 1) < 1e-6 for r in got)


def test_a10_monte_carlo(spark):
    table = spark.createDataFrame([(1, [Row(x=0.0, z=0.0), Row(x=5.0, z=0.0), Row(x=5.0, z=4.0), Row(x=0.0, z=4.0)])], "room_id int, vertices array<struct<x double, z double>>").withColumn("sigma", F.array(*map(F.lit, (0.03, 0.02, 0.04, 0.025))))
    got = measure.monte_carlo(table, "room_id").first()
    state, areas, lengths = np.random.RandomState(42), [], []
    for _ in range(1000):
        q = [(x + dx * s / math.sqrt(2), z + dz * s / math.sqrt(2)) for (x, z), s, (dx, dz) in zip([(0, 0), (5, 0), (5, 4), (0, 4)], (0.03, 0.02, 0.04, 0.025), state.standard_normal((4, 2)))]
        sides = list(zip(q, q[1:] + q[:1]))
        areas.append(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in sides)) / 2)
        lengths.append(sum(math.dist(a, b) for a, b in sides))
    want = [*np.percentile(areas, [2.5, 97.5]), np.std(areas), *np.percentile(lengths, [2.5, 97.5]), np.std(lengths)]
    assert list(got)[1:] == pytest.approx(want, rel=1e-9)


def test_e1_match_features(spark):
    rows = view(spark, SF, "measurements").filter("type = 'wall_length'").collect()

    def side(value, shift):
        return [dict(room=str(r.room_id), ord=r.part * 1000 + r.supp, entity=f"{r.entity}-{r.part}-{r.supp}", value=r[value], angle=float((r.part * 7 + shift) % 180), at=(r.entity * 3.0 + shift * 0.01, r.supp % 5 * 1.0)) for r in rows]

    want, free = [], groups(side("reference", 5), "room")
    for (room,), own in groups(side("predicted", 0), "room").items():
        left = sorted(free[(room,)], key=lambda r: (r["ord"], r["entity"]))
        for p in sorted(own, key=lambda r: (r["ord"], r["entity"])):
            costs = []
            for i, r in enumerate(left):
                turn = abs(p["angle"] - r["angle"]) % 180
                turn, far = min(turn, 180 - turn), math.dist(p["at"], r["at"])
                if turn <= evaluate.ANGLE_DEGREES and far <= evaluate.DISTANCE_M:
                    costs.append((0.4 * turn / evaluate.ANGLE_DEGREES + 0.4 * far / evaluate.DISTANCE_M + 0.2 * abs(p["value"] - r["value"]) / max(p["value"], r["value"], 0.1), i))
            costs.sort()
            if not costs:
                want.append((room, p["entity"], None, "PHANTOM"))
            elif len(costs) > 1 and costs[1][0] - costs[0][0] < evaluate.AMBIGUOUS:
                want.append((room, p["entity"], None, "AMBIGUOUS"))
            else:
                want.append((room, p["entity"], left.pop(costs[0][1])["entity"], "MATCHED"))
        want += [(room, None, r["entity"], "MISSED") for r in left]
    got = [(r.room, r.predicted, r.reference, r.status) for r in catalog.QUERIES["e1_match_features"](spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- functions and operators that no query names -------------------------------------------------------------------


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(*values):
    return [F.lit(float(v)) for v in values]


def test_small_functions(spark):
    r = one(
        spark, k=labels.scaled_intrinsics(*lit(1440, 1440, 960, 720)), wide=labels.aspect_ratio(F.lit(1920), F.lit(1080)), odd=labels.aspect_ratio(F.lit(7), F.lit(5)), up=labels.orientation(F.lit(1080), F.lit(1920), F.lit(0)), turned=labels.orientation(F.lit(1080), F.lit(1920), F.lit(90)),
        window=labels.opening_class(F.lit("Sash WINDOW")), way=labels.opening_class(F.lit("an open door")), door=labels.opening_class(F.lit("door")), clip=labels.clipped_at_border(*[F.lit(x) for x in (10, 10, 700, 20, 640, 480)]),
        beyond=plan.beyond(*lit(5, 0, 3)), within=plan.beyond(*lit(2, 0, 3)), width=plan.plan_width(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("z")), F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("z"))),
        flipped=F.array(*vectors.facing(tuple(lit(0, -1, 0, 2)), 1)), same=F.array(*vectors.facing(tuple(lit(0, -1, 0, 2)), 1, False)),
        wall=F.array(*[x for v in vectors.surface_basis(tuple(lit(1, 0, 0))) for x in v]), level=F.array(*[x for v in vectors.surface_basis(tuple(lit(0, 1, 0))) for x in v]),
        cover=uncertainty.coverage(F.lit(3), F.lit(4)), none=uncertainty.coverage(F.lit(0), F.lit(0)), area=uncertainty.area_confidence(*lit(0.9, 0.8, 0.4), F.lit(True)), planes=uncertainty.plane_confidence(F.lit(15000), F.lit(0.0)), wallc=uncertainty.wall_confidence(*lit(0.9, 0.03), F.lit(1)),
        lit15=imaging.exposed(F.lit(15)), dark=imaging.exposed(F.lit(14)), photos=imaging.photo_configuration(F.lit(5)), lone=imaging.photo_configuration(F.lit(1)), t=labels.scaled_translation(F.array(*lit(1, 2, 3)), F.lit(2.5)),
    )
    assert (r.k.fx, r.k.fy, r.k.cx, r.k.cy) == (192, 192, 128, 96)
    assert (r.wide, r.odd, r.up, r.turned) == ("16:9", "other", "portrait", "landscape")
    assert (r.window, r.way, r.door, r.clip) == ("window", "doorway", "door", True)
    assert (r.beyond, r.within, r.width) == (2, 0, 5)
    assert r.flipped == [0, 1, 0, -2] and r.same == [0, -1, 0, 2]
    for basis, n in ((r.wall, (1, 0, 0)), (r.level, (0, 1, 0))):
        a, b = np.array(basis[:3]), np.array(basis[3:])
        assert np.allclose([a @ a, b @ b, a @ b, a @ n, b @ n], [1, 1, 0, 0, 0])
    assert (r.cover, r.none) == (0.75, 1.0)
    assert r.area == pytest.approx(0.9 * 0.8 * 0.9 * 0.9) and r.planes == 0.99 and r.wallc == pytest.approx(0.9 * 0.8 * 0.85)
    assert (r.lit15, r.dark, r.photos, r.lone) == (True, False, 10, None) and r.t == [2.5, 5.0, 7.5]


def vertices(*xz):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(z)).alias("z")) for x, z in xz])


def test_polygon_turns_and_boxes(spark):
    ell = vertices((0, 0), (6, 0), (6, 2), (3, 2), (3, 5), (0, 5))
    r = one(spark, v=plan.rotated(ell, F.lit(math.pi / 2)), area=plan.area(plan.rotated(ell, F.lit(0.7))), **rooms.box(ell))
    assert [(round(p.x, 9), round(p.z, 9)) for p in r.v[:3]] == [(0, 0), (0, 6), (-2, 6)] and r.area == pytest.approx(21)
    assert (r.x_min, r.x_max, r.z_min, r.z_max) == (0, 6, 0, 5)


def test_overlap_of_any_shapes(spark):
    ell = np.array([(0, 0), (6, 0), (6, 2), (3, 2), (3, 5), (0, 5)], float)
    square = lambda x, z, w, h: np.array([(x, z), (x + w, z), (x + w, z + h), (x, z + h)], float)
    assert shapes.overlap(ell, ell) == pytest.approx(21)
    assert shapes.overlap(ell, square(3, 2, 3, 3)) == pytest.approx(0)
    assert shapes.overlap(square(2, 1, 3, 3)[::-1], ell) == pytest.approx(3 + 1 * 2)
    assert shapes.overlap(ell, ell + [1, 1]) == pytest.approx(11)
    comb = np.array([(0, 0), (7, 0), (7, 3), (6, 3), (6, 1), (4, 1), (4, 3), (3, 3), (3, 1), (1, 1), (1, 3), (0, 3)], float)
    assert sum(abs(shapes.signed_area(t)) for t in shapes.triangles(comb)) == pytest.approx(13)
    assert shapes.overlap(comb, square(0, 2, 7, 1)) == pytest.approx(3)
    table = spark.createDataFrame([(1, k, [Row(x=float(x), z=float(z)) for x, z in v]) for k, v in (("ell", ell), ("in", square(3.5, 2.5, 2, 2)), ("over", square(2, 1, 3, 3)))], "p int, room_id string, vertices array<struct<x double, z double>>")
    assert {(r.room_a, r.room_b): round(r.overlap, 6) for r in rooms.overlaps(table, ["p"]).collect()} == {("ell", "over"): 5.0, ("in", "over"): 2.25}


def test_depth_beside_missing_pixels(spark):
    flat = [(0, u, v, 1.0) for u in range(6) for v in range(6) if (u, v) != (3, 3)] + [(0, 8, 0, 7.0)]
    got = {(r.u, r.v): r.sound for r in imaging.depth_quality(spark.createDataFrame(flat, "k int, u int, v int, depth double"), ["k"]).collect()}
    assert all(got.values()) and len(got) == 36
    step = [(0, u, v, 1.0 if u < 3 else 3.0) for u in range(6) for v in range(3)] + [(0, 0, 9, float("nan"))]
    got = {(r.u, r.v): r.sound for r in imaging.depth_quality(spark.createDataFrame(step, "k int, u int, v int, depth double"), ["k"]).collect()}
    assert [got[u, 1] for u in range(6)] == [True, True, False, False, True, True] and not got[0, 9]


def test_photo_warnings(spark):
    photos = spark.createDataFrame([(1, 20.0, 100.0, 0.0, 0.0, 4000, 3000), (2, 90.0, 30.0, 0.6, 0.0, 4000, 3000), (3, 90.0, 230.0, 0.0, 0.6, 640, 480)], "photo_id int, sharpness double, mean double, dark double, bright double, width int, height int")
    like = spark.createDataFrame([(2, 1, 0.99), (3, 1, 0.5)], "photo_id int, other int, value double")
    got = {r.photo_id: r.warnings for r in imaging.photo_warnings(photos, like).collect()}
    assert got == {1: ["motion_blur_or_soft_focus"], 2: ["severe_darkness", "duplicate_viewpoint_likely"], 3: ["severe_overexposure", "low_resolution"]}


def test_poses_frames_and_planes_of_tiers(spark):
    video = spark.createDataFrame([("c", 1, "a.jpg"), ("c", 2, "b.jpg")], "capture_id string, frame int, image_name string")
    poses = spark.createDataFrame([("a.jpg", 1.0, 2.0, 3.0, [0.1, 0.2, 0.3, 0.4])], "image_name string, x double, y double, z double, q array<double>")
    lidar = spark.createDataFrame([("l", 7)], "capture_id string, frame int")
    got = {(r.tier, r.frame): r for r in imaging.frames_of_tiers(lidar, video, poses, lidar.limit(0)).collect()}
    assert got["video", 1].q == [0.2, 0.3, 0.4, 0.1] and got["video", 2].q is None and got["lidar", 7].x is None
    assert {r.image_name: r.x for r in imaging.posed_images(video.select("image_name"), poses).collect()} == {"a.jpg": 1.0, "b.jpg": None}
    cast = imaging.metric_poses(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, float("nan"), 0.0])], "image int, t array<double>"))
    assert [(r.x, r.reason) for r in cast.orderBy("image").collect()] == [(1.0, None)] + [(None, "no_translation")] * 3
    frames = spark.createDataFrame([(k, f) for k in (1, 2) for f in (5, 3, 9)], "capture_id int, frame int")
    assert sorted(map(tuple, imaging.first_frames(frames, ["capture_id"], 2).collect())) == [(1, 3), (1, 5), (2, 3), (2, 5)]
    nodes = spark.createDataFrame([(1, 0, 3), (1, 1, 9)], "capture_id int, node int, frame int")
    assert {(r.capture_id, r.frame): r.node for r in trajectory.nodes_of_frames(frames, nodes, "capture_id").collect()} == {(1, 3): 0, (1, 5): None, (1, 9): 1, (2, 3): None, (2, 5): None, (2, 9): None}
    document = spark.createDataFrame([(1, 1, None, ["p"], ["w"]), (1, 0, ["d"], None, None), (2, 0, None, None, None)], "capture_id int, priority int, detected_planes array<string>, planes array<string>, walls array<string>")
    assert {r.capture_id: (r.planes, r.status) for r in imaging.plane_documents(document).collect()} == {1: (["d"], "OK"), 2: (None, "NOT_EVALUABLE")}


def test_extents_edges_and_corners(spark):
    near = spark.createDataFrame([(1, float(i)) for i in range(101)] + [(2, float(i)) for i in range(5)], "wall_id int, x double")
    got = {r.wall_id: (r.start, r.end, r.n) for r in structure.extents(near, ["wall_id"], F.col("x")).collect()}
    assert got == {1: (1.0, 99.0, 101), 2: (0.0, 4.0, 5)}
    band = spark.createDataFrame([(1, p, d) for p, d in enumerate([2.0, 2.0, None, 2.5, 2.5, 2.5, 2.0, 2.0])] + [(2, p, 1.0) for p in range(4)], "opening_id int, pos int, depth double")
    got = {r.opening_id: (r.left, r.right, r.triggered) for r in openings.depth_edges(band, ["opening_id"]).collect()}
    assert got == {1: (3, 6, True), 2: (None, None, False)}
    seen = openings.width_interval(spark.createDataFrame([(1, w) for w in (0.88, 0.90, 0.92)] + [(2, 0.1)], "k int, width double"), ["k"])
    a, b = seen.orderBy("k").collect()
    half = 1.96 * math.sqrt(0.02**2 / 3 + 0.015**2 + 0.01**2)
    assert (a.lower, a.upper) == pytest.approx((0.9 - half, 0.9 + half)) and b.lower == 0.10


def test_polygon_quality(spark):
    edges = spark.createDataFrame([(1, 4.0, 3.0, 0.02, 0.9, False, 0.0), (1, 2.0, 2.0, 0.04, 0.7, True, 0.2)], "room_id int, length double, supported double, rmse double, confidence double, inferred boolean, extension double")
    r = measure.quality(edges, ["room_id"]).first()
    assert (r.support, r.rmse, r.confidence, r.inferred_share, r.mean_extension, r.largest_extension) == pytest.approx((5 / 6, 0.03, 0.8, 0.5, 0.1, 0.2))
    assert r.score == pytest.approx(0.4 * 5 / 6 + 0.3 * 0.8 + 0.2 * 0.5 + 0.1 * 0.8)


def test_scale_from_depth(spark):
    world = spark.createDataFrame([(1, 0.1, 0.0, 2.0, [7, 8]), (2, 0.0, 0.0, -1.0, [7]), (3, 0.0, 0.1, 4.0, [7])], "point_id int, x double, y double, z double, track array<int>")
    eye = [1.0, 0, 0, 0, 1.0, 0, 0, 0, 1.0]
    poses = spark.createDataFrame([(7, [float(x) for x in eye], [0.0, 0.0, 0.0], 100.0, 100.0, 50.0, 50.0), (8, [float(x) for x in eye], [0.0, 0.0, 1.0], 100.0, 100.0, 50.0, 50.0)], "keyframe_id int, r array<double>, t array<double>, fx double, fy double, cx double, cy double")
    depth = spark.createDataFrame([(7, 55, 50, 3.6), (8, 53, 50, 5.4), (7, 50, 52, 9.0)], "keyframe_id int, u int, v int, metres double")
    assert sorted((r.point_id, r.keyframe_id, round(r.ratio, 9)) for r in scale.depth_ratios(world, poses, depth).collect()) == [(1, 7, 1.8), (1, 8, 1.8)]
    moved = scale.applied(spark.createDataFrame([(1, [1.0, 2.0, 3.0], "r")], "k int, t array<double>, r string"), spark.createDataFrame([(1, 2.5)], "k int, scale double"), "k").first()
    assert moved.t == [2.5, 5.0, 7.5] and moved.r == "r" and moved.is_metric


def matrix(x, z, turn=0.0):
    c, s = math.cos(turn), math.sin(turn)
    return [c, 0.0, s, x, 0.0, 1.0, 0.0, 0.0, -s, 0.0, c, z, 0.0, 0.0, 0.0, 1.0]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, "b", "a", matrix(1.0, 0.0)), (1, "c", "b", matrix(0.0, 2.0, math.pi / 2))], "p int, source string, target string, matrix array<double>")
    nodes = spark.createDataFrame([(1, n) for n in "abcd"], "p int, node string")
    got = {r.node: r for r in graph.alignment_tree(edges, nodes, "p").collect()}
    place = lambda n: (round(got[n].matrix[3], 9), round(got[n].matrix[11], 9))
    assert got["d"].reason == "not_connected" and (place("b"), place("a"), place("c")) == ((0, 0), (-1, 0), (0, 2))
    scored = spark.createDataFrame([(1, 0, 100, False, 0.0, 12.0, True, [1]), (1, 1, 100, True, 0.0, 12.0, True, [2]), (1, 2, 9000, True, 0.0, 0.5, True, [3]), (1, 3, 9000, True, 0.0, 50.0, False, [4])], "k int, ord int, inliers long, has_reference boolean, mean_extension double, area double, simple boolean, cycle array<int>")
    assert graph.best_cycle(scored, "k").first().cycle == [2]
    parts = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a int, b int")
    assert sorted(map(tuple, graph.component_sizes(graph.components(parts)).collect())) == [(0, 201), (500, 2)]
    loop = trajectory.loop_residual(spark.createDataFrame([(1, 2, 1.0, 0.0, 0.0)], "source int, target int, dx double, dy double, dz double"), spark.createDataFrame([(1, 3.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0)], "node int, x double, y double, z double")).first()
    assert (loop.residual, loop.loops) == (1.0, 1)


def test_places_of_rooms(spark):
    square = lambda x, z: [Row(x=x, z=z), Row(x=x + 4.0, z=z), Row(x=x + 4.0, z=z + 4.0), Row(x=x, z=z + 4.0)]
    table = spark.createDataFrame([(1, "a", square(0.0, 0.0)), (1, "b", square(20.0, 0.0)), (2, "c", square(0.0, 0.0))], "p int, room_id string, vertices array<struct<x double, z double>>")
    walls = spark.createDataFrame([(1, 1, 2.0, 2.0), (1, 2, 7.0, 2.0), (1, 3, 12.0, 2.0), (1, 4, 17.0, -3.0)], "p int, wall_id int, x double, z double")
    got = {(r.wall_id, r.room_id): round(r.distance, 6) for r in rooms.walls_to_rooms(walls, table, ["p"]).collect()}
    assert got == {(1, "a"): 0.0, (2, "a"): 3.0}
    cells = rooms.visited_cells(spark.createDataFrame([(1, x, 0.5) for x in [0.5] * 12 + [3.0] * 4], "p int, x double, z double"), ["p"], 2.0)
    assert [(r.cx, r.poses) for r in cells.collect()] == [(0, 12)]
    shaped = rooms.room_of_cell(cells, 2.0).select(plan.area(F.col("vertices")).alias("a")).first().a
    small = rooms.room_of_cell(cells, 0.5).select(plan.area(F.col("vertices")).alias("a")).first().a
    assert (shaped, small) == (4.0, 16.0)


def test_reports(spark):
    tiers = spark.createDataFrame([("lidar", 1.0, [], 4), ("video", 0.4, ["registration_failure"], 2), ("photo", 0.9, [], None), ("damage", 1.0, [], 0)], "tier string, coverage double, failures array<string>, produced int")
    assert tuple(evaluate.worst_failure(tiers).first()) == ("video", 95, "video registration")
    assert {r.tier: r.status for r in evaluate.tier_status(tiers).collect()} == {"lidar": "COMPLETE", "video": "PROVISIONAL", "photo": "NOT_EVALUABLE", "damage": "FAILED"}
    fixtures = spark.createDataFrame([(1, "mold", 1.0, None), (2, "burn", 2.0, 1.5)], "fixture_id int, true_class string, true_area double, true_length double")
    predicted = spark.createDataFrame([(1, "mold", 1.1, None)], "fixture_id int, predicted_class string, predicted_area double, predicted_length double")
    a, b = evaluate.damage_fixtures(fixtures, predicted).orderBy("fixture_id").collect()
    assert a.area_error == pytest.approx(0.1) and a.class_right and a.length_error is None and b.area_error is None and b.class_right is None
    poses = spark.createDataFrame([(1, f, f / 10, 0.123456, 0.0, 0.0) for f in range(25)], "trajectory_id int, frame int, ts_s double, x double, y double, z double")
    assert [(r.frame, r.x) for r in writers.sampled_trajectory(poses).orderBy("frame").collect()] == [(0, 0.1235), (10, 0.1235), (20, 0.1235)]
    loops = spark.createDataFrame([(1, 0, 9, "accepted", []), (1, 2, 8, "rejected", ["low_fitness"])], "trajectory_id int, source int, target int, decision string, reasons array<string>")
    r = writers.loop_document(loops).first()
    assert (r.accepted, r.uncertain, r.rejected) == (1, 0, 1)
    files = spark.createDataFrame([("s.zip", n) for n in ("x/odometry.csv", "x/camera_matrix.csv", "x/depth/0.png", "x/depth/1.png", "x/confidence/0.png", "x/rgb.mp4")], "archive string, name string")
    r = readers.archive_contents(files).first()
    assert (r.odometry, r.camera_matrix, r.depth, r.confidence) == (1, 1, 2, 1)
    assert readers.frame_count(poses) == 25


def test_points_without_neighbours_nearby(spark):
    rows = [(i, i * 0.1, 0.0, 0.0) for i in range(30)] + [(99, 500.0, 0.0, 0.0)]
    table = spark.createDataFrame([(i, float(x), y, z) for i, x, y, z in rows], "point_id int, x double, y double, z double")
    kept = {r.point_id for r in points.without_outliers(table, "point_id", 5, 2.0, 0.2).collect()}
    assert kept == set(range(30))
    pair = table.filter("point_id in (0, 99)")
    assert points.without_outliers(pair, "point_id", 5, 2.0, 0.2).count() == 2  # both are as far from each other


def test_host_planes_ask_for_captures(spark):
    rays = spark.createDataFrame([(1, 1, *[0.0] * 5, 1.0)], "mask_id int, capture_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    planes = spark.createDataFrame([(k, k, k, 0.0, 0.0, 1.0, -2.0) for k in (1, 2)], "capture_id int, plane_id int, ord int, a double, b double, c double, d double")
    assert damage.host_planes(rays, planes).select("plane_id").first().plane_id == 1
    with pytest.raises(Exception, match="capture_id"):
        damage.host_planes(rays, planes.drop("capture_id")).count()
