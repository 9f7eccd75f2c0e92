"""Registration of clouds with planted motions."""

import numpy as np
import pytest

from planimetra.functions import clouds, motions
from planimetra.operators import imaging, registration, trajectory
from planimetra.plans import catalog


def motion(turn, place):
    return motions.joined(motions.turned(np.array([turn], float)), np.array([place], float)).reshape(4, 4)


def moved(p, m):
    return p @ m[:3, :3].T + m[:3, 3]


def room(n, seed=0, noise=0.0):
    """Points on the walls, floor and furniture of a room without symmetry, 4 x 3 x 2.4 m."""
    rng = np.random.default_rng(seed)
    boxes = [([0, 0, 0], [4, 0, 3]), ([0, 0, 0], [0, 2.4, 3]), ([0, 0, 0], [4, 2.4, 0]), ([4, 0, 0], [4, 2.4, 1.8]), ([0.6, 0, 0.4], [0.6, 1.1, 1.3]), ([0.6, 1.1, 0.4], [1.4, 1.1, 1.3]), ([2.6, 0, 2.2], [3.3, 0.7, 2.2]), ([2.6, 0.7, 2.2], [3.3, 0.7, 2.9]), ([1.9, 0, 0.9], [2.2, 1.6, 0.9])]
    sizes = np.array([np.prod([b - a for a, b in zip(*x) if b != a]) for x in boxes])
    pick = rng.choice(len(boxes), n, p=sizes / sizes.sum())
    low, high = (np.array([x[k] for x in boxes], float)[pick] for k in (0, 1))
    return low + rng.uniform(size=(n, 3)) * (high - low) + rng.normal(0, noise, (n, 3)) if noise else low + rng.uniform(size=(n, 3)) * (high - low)


def rows(p):
    return [list(map(float, x)) for x in p]


def test_grid_neighbours_equal_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    p, q = rng.uniform(-3, 3, (300, 3)), rng.uniform(-4, 4, (200, 3))
    d = np.linalg.norm(q[:, None] - p[None], axis=2)
    for limit in (1_000_000, 50):
        monkeypatch.setattr(clouds, "_PAIRS", limit)
        grid = clouds.Grid(p, 0.7)
        met = {(a, b) for x, y, _ in grid.pairs(q) for a, b in zip(x.tolist(), y.tolist())}
        assert met == {tuple(x) for x in np.argwhere(d <= 0.7).tolist()}
        near, far = grid.nearest(q)
        assert np.array_equal(near, np.where(d.min(axis=1) <= 0.7, d.argmin(axis=1), -1)) and np.allclose(far[near >= 0], d.min(axis=1)[near >= 0])
    flat = clouds.normals(np.column_stack([rng.uniform(0, 2, (400, 2)), np.zeros(400)]), 0.4)
    assert np.allclose(np.abs(flat[:, 2]), 1)


def test_planted_motion_of_large_clouds(spark):
    m = motion([0.02, 0.05, -0.03], [0.06, -0.04, 0.05])
    s, t = room(20_000, 1, 0.003), room(20_000, 2, 0.003)
    table = spark.createDataFrame([(1, rows(s), rows(moved(t, m)), None), (2, rows(s), rows(moved(t, m)), m.ravel().tolist()), (3, rows(s[:19]), rows(t), None), (4, None, rows(t), None)], "pair_id long, source array<array<double>>, target array<array<double>>, start array<double>")
    got = {r.pair_id: r for r in registration.registered(table).collect()}
    for k in (1, 2):
        assert np.allclose(np.array(got[k].matrix).reshape(4, 4), m, atol=2e-3) and got[k].fitness > 0.99 and got[k].correspondences > 19_000
    assert got[1].shift == pytest.approx(np.linalg.norm(m[:3, 3]), abs=0.01) and got[1].turn == pytest.approx(np.degrees(np.linalg.norm([0.02, 0.05, -0.03])), abs=0.1) and got[2].shift < 0.003
    info = np.array(got[1].information).reshape(6, 6)
    assert np.allclose(info, info.T) and info[5, 5] == got[1].correspondences and np.linalg.eigvalsh(info)[0] > 0
    assert {got[k].reason for k in (3, 4)} == {"few_points"} and got[3].matrix is None
    judged = trajectory.validated_loops(registration.registered(table.filter("pair_id = 2"))).first()
    assert judged.decision == "accepted"


def test_small_clouds_without_normals_go_point_to_point():
    rng = np.random.default_rng(6)
    s = rng.uniform(0, 40, (30, 3))
    m = motion([0, 0.002, 0], [0.05, 0.02, 0])
    move, partner, _ = clouds.aligned(s, moved(s, m), np.zeros((30, 3)), np.eye(4), 0.4)
    assert np.allclose(move, m, atol=1e-6) and (partner == np.arange(30)).all()


def test_information_falls_back_where_singular():
    line = np.column_stack([np.linspace(0, 1e5, 50), np.zeros((50, 2))])
    assert np.array_equal(clouds.information(line, 0.5), np.eye(6) * 50)


def test_rooms_without_a_start(spark):
    m = motion([0, 2.1, 0], [3.0, 0.2, -5.0])
    whole, again = room(6000, 1, 0.004), room(6000, 2, 0.004)
    part = again[again[:, 0] < 3.2]
    rng = np.random.default_rng(9)
    ball = rng.normal(size=(3000, 3))
    ball = 1.5 * ball / np.linalg.norm(ball, axis=1)[:, None]
    clouds_ = {"a": whole, "b": moved(part, m), "c": ball, "d": whole[:50]}
    data = [(k, i * 10 + n, *map(float, p)) for n, (k, c) in enumerate(clouds_.items()) for i, p in enumerate(c)]
    cloud = spark.createDataFrame(data, "room string, point_id long, x double, y double, z double")
    pairs = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "b"), ("a", "nowhere")], "source string, target string")
    got = {(r.source, r.target): r for r in registration.registered_rooms(cloud, pairs, "room", tries=20_000).collect()}
    assert len(got) == 4
    assert got["a", "b"].accepted and np.allclose(np.array(got["a", "b"].matrix).reshape(4, 4), m, atol=0.06)
    assert not got["c", "b"].accepted and got["c", "b"].reason in ("weak_shared_geometry", "no_common_triples")
    assert got["d", "b"].reason == got["a", "nowhere"].reason == "insufficient_cloud_points"


def test_features_do_not_change_with_a_motion(spark):
    m = motion([0.3, 1.0, 0.2], [3, 1, 2])
    p = room(500, 3)
    n = clouds.normals(p, 0.5)
    data = [("a", i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(p, n))] + [("b", i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(moved(p, m), n @ m[:3, :3].T))]
    table = spark.createDataFrame(data, "room string, point_id long, x double, y double, z double, nx double, ny double, nz double")
    got = {(r.room, r.point_id): np.array(r.feature) for r in registration.features(table, ["room"], 0.6).collect()}
    same = [np.abs(got["a", i] - got["b", i]).max() for i in range(500) if ("a", i) in got]
    assert len(same) > 450 and np.median(same) < 1e-6
    assert all(abs(f[g * 11 : g * 11 + 11].sum() - 100) < 1e-6 for f in got.values() for g in range(3))


@pytest.mark.parametrize("name", ["i14_registrations", "i15_room_registrations"])
def test_queries(spark, name):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.off < 0.05 for r in got if r.accepted) and any(r.accepted for r in got)


def test_features_of_a_room_equal_those_by_joins(spark):
    p = np.unique(room(700, 3), axis=0)
    points, normals, got = clouds.described(p, 0.4, 0.6, registration.BINS)
    data = [("a", i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(points, normals))]
    table = spark.createDataFrame(data, "room string, point_id long, x double, y double, z double, nx double, ny double, nz double")
    joined = {r.point_id: np.array(r.feature) for r in registration.features(table, ["room"], 0.6).collect()}
    off = np.array([np.abs(joined[i] - got[i]).max() for i in range(len(points))])
    # an angle on the edge of a bin may fall on either side of it
    assert len(joined) == len(points) > 600 and (off < 1e-6).mean() > 0.95, (len(joined), len(points), off.mean(), (off < 1e-6).mean())
    turned = imaging.normals(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "point_id long, x double, y double, z double"), "point_id", 0.4).collect()
    where = {tuple(x): n for x, n in zip(points.tolist(), normals)}
    # two neighbours are a line, whose plane is open
    assert np.mean([abs(abs(where[tuple(p[r.point_id].tolist())] @ np.array([r.nx, r.ny, r.nz])) - 1) < 1e-6 for r in turned if tuple(p[r.point_id].tolist()) in where]) > 0.97


def test_pairs_of_neighbours_are_not_written(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(registration, "cut", lambda df: written.append(df.count()) or df)
    cloud = spark.createDataFrame([(k, i, *map(float, x)) for k in "ab" for i, x in enumerate(room(2000, 1))], "room string, point_id long, x double, y double, z double")
    registration.registered_rooms(cloud, spark.createDataFrame([("a", "b")], "source string, target string"), "room").collect()
    assert sum(written) <= 2 * 2000
