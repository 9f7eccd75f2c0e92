"""Pose graphs against numeric derivatives, planted loops and the gates of a safe adjustment."""

import numpy as np
import pytest

from planimetra.functions import motions
from planimetra.operators import posegraph
from planimetra.plans import catalog

EDGE = "t int, source long, target long, matrix array<double>, information array<double>, is_loop boolean, uncertain boolean"
NODE = "t int, node long, matrix array<double>"


def motion(turn, place):
    return motions.joined(motions.turned(np.array([turn], float)), np.array([place], float)).reshape(4, 4)


def rows(matrices):
    return [(1, i, m.ravel().tolist()) for i, m in enumerate(matrices)]


def edge(source, target, matrix, weight=100.0, loop=False, uncertain=False):
    return (1, source, target, matrix.ravel().tolist(), (np.eye(6) * weight).ravel().tolist(), loop, uncertain)


def between(i, j):
    return np.linalg.inv(j) @ i


def drifted(n=40, turn=0.004, shift=0.01):
    """A walk around a circle, and the same with a drift that grows; both as matrices."""
    true = [motion([0, 2 * np.pi * k / n, 0], [3 * np.cos(2 * np.pi * k / n), 0.1 * np.sin(k), 3 * np.sin(2 * np.pi * k / n)]) for k in range(n)]
    return true, [motion([turn / 4 * k, turn * k, 0], [shift * k * 0.5, 0, -shift * k * 0.3]) @ m for k, m in enumerate(true)]


def test_turns_and_their_vectors():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(200, 3))
    w *= (rng.uniform(0, np.pi - 1e-3, 200) / np.linalg.norm(w, axis=1))[:, None]
    w[:3] = [[0, 0, 0], [1e-10, 0, 0], [0, np.pi - 1e-6, 0]]
    r = motions.turned(w)
    assert np.allclose(r @ np.swapaxes(r, 1, 2), np.eye(3)) and np.allclose(motions.turns(r), w, atol=1e-7)


def test_jacobians_are_derivatives():
    rng = np.random.default_rng(2)
    r, t = motions.turned(rng.normal(size=(4, 3)) * 0.8), rng.normal(size=(4, 3))
    zr, zt = motions.turned(rng.normal(size=(3, 3)) * 0.5), rng.normal(size=(3, 3))
    graph = posegraph.Graph(np.array([0, 1, 2]), np.array([1, 2, 3]), zr, zt, np.tile(np.eye(6), (3, 1, 1)), np.zeros(3, bool))
    _, js, je = graph.errors(r, t)
    for node in range(4):
        for axis in range(6):
            step = np.zeros((4, 6))
            step[node, axis] = 1e-6
            moved = [graph.errors(r @ motions.turned(s * step[:, :3]), t + np.einsum("nij,nj->ni", r, s * step[:, 3:]))[0] for s in (1, -1)]
            numeric = (moved[0] - moved[1]) / 2e-6
            want = np.zeros((3, 6))
            for e in range(3):
                want[e] = (js[e][:, axis] if graph.source[e] == node else 0) + (je[e][:, axis] if graph.target[e] == node else 0)
            assert np.allclose(numeric, want, atol=1e-6)


def test_planted_loop_with_turned_edges(spark):
    true, raw = drifted()
    edges = [edge(i, i + 1, between(true[i], true[i + 1])) for i in range(39)] + [edge(0, 39, between(true[0], true[39]), 400.0, True)]
    got = sorted(posegraph.optimised(spark.createDataFrame(rows(raw), NODE), spark.createDataFrame(edges, EDGE), "t").collect(), key=lambda r: r.node)
    assert {r.status for r in got} == {"improved"} and got[0].residual < 1e-4 < 0.1 < got[0].raw_residual and got[0].gain_pct > 99
    want = [raw[0] @ np.linalg.inv(true[0]) @ m for m in true]
    assert np.allclose([np.array(r.matrix).reshape(4, 4) for r in got], want, atol=1e-4)


def test_equals_a_dense_minimum():
    """Edges that contradict each other: the cost has no lower neighbour, and a dense solver with numeric derivatives ends at the same place."""
    rng = np.random.default_rng(5)
    true, raw = drifted(8)
    ends = [(i, i + 1) for i in range(7)] + [(0, 7), (1, 5)]
    z = [between(true[i], true[j]) @ motion(rng.normal(size=3) * 0.02, rng.normal(size=3) * 0.05) for i, j in ends]
    zr, zt = motions.split(np.array(z).reshape(-1, 16))
    weights = np.array([np.diag(rng.uniform(50, 300, 6)) for _ in ends])
    graph = posegraph.Graph(*np.array(ends).T, zr, zt, weights, np.zeros(len(ends), bool))
    r, t = motions.split(np.array(raw).reshape(-1, 16))
    got_r, got_t, _ = posegraph.adjusted(graph, r, t)

    def error(x, r, t):
        full = np.concatenate([np.zeros((1, 6)), x.reshape(-1, 6)])
        e = graph.errors(r @ motions.turned(full[:, :3]), t + np.einsum("nij,nj->ni", r, full[:, 3:]))[0]
        return np.concatenate([np.sqrt(np.diag(w)) * v for w, v in zip(weights, e)])

    for _ in range(30):
        zero = np.zeros(42)
        base = error(zero, r, t)
        j = np.stack([(error(h, r, t) - error(-h, r, t)) / 2e-6 for h in np.eye(42) * 1e-6], axis=1)
        x = np.concatenate([np.zeros((1, 6)), -np.linalg.solve(j.T @ j + 1e-9 * np.eye(42), j.T @ base).reshape(-1, 6)])
        r, t = r @ motions.turned(x[:, :3]), t + np.einsum("nij,nj->ni", r, x[:, 3:])
    assert np.allclose(got_t, t, atol=1e-5) and np.allclose(got_r, r, atol=1e-5)


def test_square_with_drift(spark):
    places = np.array([[0, 0, 0], [5, 0, 0], [5, 0, 5], [0, 0, 5], [0, 0, 0]], float)
    drift = np.array([0.28, 0, 0.28])
    raw = [motion([0, 0, 0], p + k / 4 * drift) for k, p in enumerate(places)]
    nodes = spark.createDataFrame(rows(raw), NODE)
    edges = [edge(i, i + 1, between(raw[i], raw[i + 1])) for i in range(4)] + [edge(0, 4, np.eye(4), 1000.0, True)]
    got = sorted(posegraph.optimised(nodes, spark.createDataFrame(edges, EDGE), "t").collect(), key=lambda r: r.node)
    assert got[0].status == "improved" and got[0].raw_residual == pytest.approx(0.396, abs=1e-3) and got[0].residual < 0.05
    assert np.linalg.norm(np.array(got[4].matrix)[[3, 7, 11]]) < np.linalg.norm(drift) / 5
    assert {tuple(e.matrix) for e in posegraph.odometry(nodes, "t").collect()} == {tuple(e[3]) for e in edges[:4]}


def test_gates(spark):
    _, raw = drifted(20)
    nodes = spark.createDataFrame(rows(raw), NODE)
    chain = [edge(i, i + 1, between(raw[i], raw[i + 1])) for i in range(19)]
    result = lambda more: posegraph.optimised(nodes, spark.createDataFrame(chain + more, EDGE), "t").first()
    none = result([])
    assert (none.status, none.reasons, none.residual, none.gain_pct) == ("neutral", ["no_loop_closures_present"], 0.0, 0.0)
    far = result([edge(0, 19, between(raw[0], raw[19]) @ motion([0, 0, 0], [6, 0, 0]), 1e4, True)])
    assert far.status == "rejected" and "excessive_node_displacement" in far.reasons[0] and far.matrix == raw[0].ravel().tolist()
    weak = result([edge(0, 19, between(raw[0], raw[19]) @ motion([0, 0, 0], [0.3, 0, 0]), 0.005, True)])
    assert weak.status == "neutral" and 0 < weak.gain_pct < 5


def test_untrue_uncertain_loops_are_pruned(spark):
    true, raw = drifted(20)
    nodes = spark.createDataFrame(rows(raw), NODE)
    chain = [edge(i, i + 1, between(true[i], true[i + 1]), 1e4) for i in range(19)]
    sound = [edge(0, 18, between(true[0], true[18]), 1e4, True)]
    wrong = [edge(2, 15, between(true[2], true[15]) @ motion([0, 0.5, 0], [2, 0, 1]), 20.0, True, True)]
    lists = [sorted(posegraph.optimised(nodes, spark.createDataFrame(chain + sound + w, EDGE), "t").collect(), key=lambda r: r.node) for w in ([], wrong)]
    places = [np.array([np.array(r.matrix)[[3, 7, 11]] for r in x]) for x in lists]
    assert np.allclose(*places, atol=1e-3)


def test_loops_weigh_by_decision(spark):
    table = spark.createDataFrame([(1, 0, 9, [0.0] * 16, [10.0] * 36, d) for d in ("accepted", "uncertain", "rejected")], "t int, source long, target long, matrix array<double>, information array<double>, decision string")
    got = {(r.uncertain, r.information[0], r.is_loop) for r in posegraph.loops(table).collect()}
    assert got == {(False, 10.0, True), (True, 2.0, True)}


def test_long_walks_and_odd_rows(spark):
    true, raw = drifted(600, 0.0001, 0.0005)
    chain = [edge(i, i + 1, between(true[i], true[i + 1])) for i in range(599)]
    odd = [edge(0, 5000, np.eye(4), loop=True), (1, 3, 4, None, None, True, None)]
    got = posegraph.optimised(spark.createDataFrame([*rows(raw), (1, None, None), rows(raw)[7]], NODE), spark.createDataFrame([*chain, edge(0, 599, between(true[0], true[599]), 400.0, True), *odd], EDGE), "t").collect()
    assert len(got) == 600 and got[0].status == "improved" and got[0].residual < 1e-3
    assert posegraph.optimised(spark.createDataFrame([], NODE), spark.createDataFrame(chain, EDGE), "t").count() == 0
    assert {r.status for r in posegraph.optimised(spark.createDataFrame(rows(raw[:3]), NODE), spark.createDataFrame([], EDGE), "t").collect()} == {"neutral"}


def test_corrections_between_keyframes(spark):
    poses = [motion([0, 0.1 * k, 0], [k, 0, 0]) for k in range(11)]
    table = spark.createDataFrame([(1, k, float(k), p.ravel().tolist()) for k, p in enumerate(poses)] + [(2, 0, 0.0, np.eye(4).ravel().tolist())], "t int, frame int, ts_s double, matrix array<double>")
    change = {2: np.eye(4), 6: motion([0, 0.4, 0], [1, 0, 2]), 8: motion([0, 0.4, 0], [1, 0, 2])}
    keys = spark.createDataFrame([(1, float(k), poses[k].ravel().tolist(), (c @ poses[k]).ravel().tolist()) for k, c in change.items()], "t int, ts_s double, raw array<double>, matrix array<double>")
    got = {(r.t, r.frame): np.array(r.matrix).reshape(4, 4) for r in posegraph.corrected_poses(table, keys, "t").collect()}
    assert len(got) == 12 and np.allclose(got[2, 0], np.eye(4))
    for k, share in ((0, 0.0), (2, 0.0), (3, 0.25), (5, 0.75), (6, 1.0), (7, 1.0), (10, 1.0)):
        assert np.allclose(got[1, k], motion([0, 0.4 * share, 0], [share, 0, 2 * share]) @ poses[k])


def test_query(spark):
    got = catalog.QUERIES["i16_pose_graphs"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.status == "improved" and r.residual < 0.1 * r.raw_residual for r in got if r.raw_residual > 0.05)
    assert any(r.raw_residual > 0.05 for r in got)
