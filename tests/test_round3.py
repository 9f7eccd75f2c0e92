"""Faults that larger tables showed."""

import math
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as entry
from planimetra.functions import shapes
from planimetra.operators import damage, graph, imaging, measure, openings, rooms, spatial, structure


def written(spark, path, **tables):
    """A folder of tables as the driver keeps them."""
    for name, rows in tables.items():
        spark.createDataFrame(rows[1], rows[0]).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_slab_distances_that_round_up_to_the_limit_are_outside(spark, tmp_path):
    # wall 0: a 1, b 0, c 0, d 0.1 * s_acctbal / 2000
    points = [(i, [x / 10] + [0.0] * 7, 0) for i, x in enumerate((0.3999, 0.3999998, 0.4001))]
    folder = written(spark, tmp_path, supplier=("s_suppkey long, s_nationkey int, s_acctbal double", [(0, 0, 0.0)]), embeddings=("vec_id long, embedding array<double>, label int", points))
    assert [(r.point_id, r.plane_distance) for r in entry.queries()["j4_points_in_slabs"](spark, folder).collect()] == [(0, 0.3999)]


def test_errors_are_summed_in_order(spark):
    errors = [0.1, 0.2, 0.3, 1e16, -1e16, 0.7]
    rows = [(1, i, float(i), 0.0, 0.0, e, len(errors)) for i, e in enumerate(errors)]
    table = spark.createDataFrame(rows[::-1], "k long, ord long, x double, y double, z double, error double, total long").repartition(6)
    total = 0.0
    for e in errors:
        total += e
    assert imaging.sfm_status(table, ["k"]).first().error == total / len(errors)


def test_room_measurements_broadcast_no_table_that_grows(spark, tmp_path):
    folder = written(spark, tmp_path, orders=("o_orderkey long, o_custkey long", [(i, i % 7) for i in range(50)]))
    plan = entry.queries()["a11_room_measurements"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_monte_carlo_is_spread_and_equals_one_room_at_a_time(spark):
    shapes_ = {1: [(0, 0), (5, 0), (5, 4), (0, 4)], 2: [(0, 0), (3, 0), (0, 3)], 3: [(1, 1), (4, 1), (4, 6), (1, 6)]}
    rows = [(k, [Row(x=float(x), z=float(z)) for x, z in v], [0.01 * k * (i + 1) for i in range(len(v))]) for k, v in shapes_.items()]
    table = spark.createDataFrame(rows, "k long, vertices array<struct<x double, z double>>, sigma array<double>").coalesce(1)
    found = measure.monte_carlo(table, "k", samples=200)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {r.k: tuple(r)[1:] for r in found.collect()}
    for k, vertices, sigma in rows:
        p = np.array([(v.x, v.z) for v in vertices])
        q = p[None] + np.random.RandomState(42).standard_normal((200, len(p), 2)) * np.array(sigma)[None, :, None] / np.sqrt(2)
        r = np.roll(q, -1, axis=1)
        area, length = np.abs((q[:, :, 0] * r[:, :, 1] - r[:, :, 0] * q[:, :, 1]).sum(axis=1)) / 2, np.hypot(*(r - q).transpose(2, 0, 1)).sum(axis=1)
        assert got[k] == pytest.approx([f for x in (area, length) for f in (*np.percentile(x, [2.5, 97.5]), x.std())], rel=1e-12)


def test_masks_with_the_same_rays_meet_planes_once(spark):
    rays = spark.createDataFrame([(m, 1, 0.0, 1.5, 0.0, dx, 0.0, 1.0) for m in range(200) for dx in (-0.2, 0.0, 0.2)], "mask_id long, capture_id int, ox double, oy double, oz double, dx double, dy double, dz double")
    planes = spark.createDataFrame([(1, k, k, 0.0, 0.0, 1.0, -2.0) for k in (4, 3)], "capture_id int, plane_id long, ord long, a double, b double, c double, d double")
    found = damage.host_planes(rays, planes)
    assert sorted(tuple(r) for r in found.collect()) == [(m, 3, 3, 3) for m in range(200)]
    assert "distinct" in damage.host_planes.__code__.co_names


def test_hull_areas_are_dealt_in_batches(spark):
    grid = spark.createDataFrame([(m, float(u), float(v)) for m in range(30) for u in range(3) for v in range(m % 3 + 1)], "mask long, u double, v double").coalesce(1)
    found = damage.area_extents(grid, "mask")
    assert {r.mask: (r.area, r.n_points) for r in found.collect()} == {m: (2.0 * (m % 3), 3 * (m % 3 + 1)) for m in range(30)}
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [2, 3, 512])
def test_corner_numbers_do_not_depend_on_blocks(spark, block):
    lines = [(c, i, i, Row(a=math.cos(0.9 * i), b=math.sin(0.9 * i), c=0.3 * i), 0.0, 0.0, 1.0, 1.0) for c in (1, 2) for i in range(9)]
    walls = spark.createDataFrame(lines, "capture_id int, wall_id long, ord long, line struct<a double, b double, c double>, x1 double, z1 double, x2 double, z2 double")
    found = structure.corners(walls, ["capture_id"], block=block).collect()
    for c in (1, 2):
        own = sorted((r.ord_a, r.ord_b, r.corner, r.x) for r in found if r.capture_id == c)
        assert len(own) == 36 and [r[2] for r in own if r[3] is not None] == list(range(1, 1 + sum(r[3] is not None for r in own)))
        assert all(r[2] is None for r in own if r[3] is None)
    assert structure.wall_pairs(walls, ["capture_id"], block).count() == 72


def test_small_images_are_moved_as_they_are(spark):
    frames = spark.createDataFrame([(1, f, 3, 2, [f * 10 + i for i in range(6)]) for f in range(3)], "video int, frame int, width int, height int, pixels array<int>")
    found = imaging.image_measures(frames, "video")
    assert [r.motion for r in found.orderBy("frame").collect()] == pytest.approx([0.0, 10.0, 10.0])
    assert "array<smallint>" not in found._jdf.queryExecution().analyzed().toString()


def test_crowded_points_look_nearby_first(spark):
    p = np.random.default_rng(3).normal(size=(600, 3))
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "k long, x double, y double, z double")
    assert spatial._crowded(points, ["x", "y", "z"], 1.5, 5, []) < 1.0
    got = sorted((r.k, r["rank"], r.neighbour) for r in spatial.nearest_among(points, ["x", "y", "z"], 1.5, 5, "k").collect())
    d = np.linalg.norm(p[:, None] - p[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert got == [(i, j + 1, int(n)) for i in range(600) for j, n in enumerate(np.argsort(d[i])[:5]) if d[i][n] <= 1.5]


def all_cycles(edges, longest):
    """Depth first from each least corner."""
    near, found = {}, set()
    for s, t, w in edges:
        near.setdefault(s, set()).add((t, w))
        near.setdefault(t, set()).add((s, w))

    def walk(path, wall):
        for t, w in near[path[-1]]:
            if w == wall:
                continue
            if t == path[0] and len(path) >= 3:
                found.add(min(tuple(path), (path[0], *path[:0:-1])))
            elif t > path[0] and t not in path and len(path) < longest:
                walk([*path, t], w)

    for start in near:
        walk([start], None)
    return found


@pytest.mark.parametrize("longest", [3, 6, 9])
def test_cycles_are_joins_of_half_walks(spark, longest):
    rng = np.random.default_rng(longest)
    # walls are runs of corners, some corners are met twice, some edges by two walls
    edges = {c: sorted({(*sorted(map(int, rng.choice(14, 2, replace=False))), int(rng.integers(0, 9))) for _ in range(26)}) for c in (1, 2)}
    table = spark.createDataFrame([(c, *(e if i % 2 else (e[1], e[0], e[2]))) for c, v in edges.items() for i, e in enumerate(v)], "capture_id int, source int, target int, wall_id int")
    found = graph.cycles(table, "capture_id", longest)
    assert "Pandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r.capture_id, tuple(r.cycle)) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == {(c, k) for c, v in edges.items() for k in all_cycles(v, longest)} and len(got) > 2


def test_gaps_of_many_pairs_equal_those_of_one(spark):
    rng = np.random.default_rng(2)
    for n, m in ((4, 4), (3, 5), (6, 3)):
        one, two = rng.integers(0, 6, (300, n, 2)).astype(float), rng.integers(0, 6, (300, m, 2)) + rng.integers(0, 8, (300, 1, 2)).astype(float)
        assert shapes.polygon_gaps(one, two) == pytest.approx([shapes.polygon_gap(a, b) for a, b in zip(one, two)], abs=1e-12)


def test_neighbours_take_microseconds_a_pair():
    one = np.array([[0, 0], [3, 0], [3, 2], [0, 2]], float) + np.zeros((50_000, 1, 1))
    two = one + [3.1, 1.0]
    place = lambda p: pa.ListArray.from_arrays(np.arange(0, 4 * len(p) + 1, 4, dtype=np.int32), pa.StructArray.from_arrays([*p.reshape(-1, 2).T.copy()], names=["x", "z"]))
    start = time.process_time()
    (out,) = rooms._neighbours([pa.record_batch({"room_a": np.arange(len(one)), "va": place(one), "vb": place(two)})])
    # one pair after another takes about 0.3 ms
    assert time.process_time() - start < 5
    assert np.allclose(out.column("gap"), 0.1) and np.allclose(out.column("contact"), 1.0) and out.column("room_a").to_pylist() == list(range(len(one)))


def test_openings_meet_the_walls_of_their_cell(spark):
    rng = np.random.default_rng(5)
    ends = rng.uniform(-6, 6, (60, 4))
    ends[:10, 2] = ends[:10, 0]
    ends[10:20, 3] = ends[10:20, 1]
    ends[20] = [1, 1, 1, 1]
    doors = rng.uniform(-6, 6, (400, 2))
    walls = spark.createDataFrame([(1, i, i, *map(float, e)) for i, e in enumerate(ends)], "c int, wall_id int, ord int, x1 double, z1 double, x2 double, z2 double")
    table = spark.createDataFrame([(1, i, float(x), float(z), 1.0, 0.5) for i, (x, z) in enumerate(doors)], "c int, opening_id int, x double, z double, width double, score double")
    found = openings.to_walls(table, walls, ["c"])
    got = {r.opening_id: (r.wall_id, r.distance) for r in found.collect()}
    run = ends[:, 2:] - ends[:, :2]
    t = np.clip(((doors[:, None] - ends[:, :2]) * run).sum(axis=2) / np.maximum((run**2).sum(axis=1), 1e-12), 0, 1)
    far = np.linalg.norm(doors[:, None] - ends[:, :2] - t[..., None] * run, axis=2)
    # beyond nine tenths of the reach all walls are worth the same, and the first wins
    value = np.where(far <= 0.45, 0.5 * np.maximum(0.1, 1 - far / 0.45), -1)
    want = {i: int(v.argmax()) for i, v in enumerate(value) if v.max() > 0}
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] == pytest.approx(far[k, v[0]]) for k, v in got.items())
    assert "_gx" in found._jdf.queryExecution().optimizedPlan().toString()
