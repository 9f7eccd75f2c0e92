"""Rigid registration of point clouds: from a known start, and of rooms without one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimetra.functions import clouds, motions
from planimetra.functions.vectors import cross, dot, minus, unit
from planimetra.operators import points, spatial
from planimetra.operators.shared import cut, spread

#: Clouds under so many points are not registered: keyframes, rooms.
LEAST_POINTS, LEAST_ROOM_POINTS = 20, 100
#: A registration of rooms is accepted with this fitness at least and this rmse at most.
LEAST_FITNESS, MOST_RMSE = 0.18, 0.20
BINS = 11


def _cloud(rows) -> np.ndarray:
    return np.array([list(p) for p in rows], float).reshape(-1, 3)


def registered(pairs: DataFrame, radius: float = 0.20, rounds: int = 40) -> DataFrame:
    """Each pair of clouds (pair_id, source, target: arrays of arrays of 3, and start, a matrix of 16, or null) laid on each other, points on planes.

    Adds fitness, rmse, correspondences, matrix, information (36), shift and turn (how far from start, in m and degrees) and reason: 'few_points' for a
    cloud that is null or has under LEAST_POINTS points, with nulls elsewhere. A row is one task's work: clouds are voxels of a keyframe.
    """
    schema = "pair_id long, fitness double, rmse double, correspondences long, matrix array<double>, information array<double>, shift double, turn double, reason string"
    start = F.col("start").cast("array<double>") if "start" in pairs.columns else F.lit(None).cast("array<double>")

    def run(batches):
        for pdf in batches:
            out = []
            for k, s, t, start in zip(pdf["pair_id"], pdf["source"], pdf["target"], pdf["start"]):
                s, t = (np.zeros((0, 3)) if x is None else _cloud(x) for x in (s, t))
                if min(len(s), len(t)) < LEAST_POINTS:
                    out.append((k, *[None] * 7, "few_points"))
                    continue
                first = np.eye(4) if start is None else np.array(start, float).reshape(4, 4)
                move, partner, distance = clouds.aligned(s, t, clouds.normals(t, radius), first, radius, rounds)
                met = partner >= 0
                fitness = float(met.mean())
                weight = clouds.information(t[partner[met]], fitness)
                turn = float(np.degrees(np.linalg.norm(motions.turns((move[:3, :3] @ first[:3, :3].T)[None]))))
                rmse = float(np.sqrt((distance[met] ** 2).mean())) if met.any() else 0.0
                out.append((k, fitness, rmse, int(met.sum()), move.ravel().tolist(), weight.ravel().tolist(), float(np.linalg.norm(move[:3, 3] - first[:3, 3])), turn, None))
            frame = pd.DataFrame(out, columns=["pair_id", "fitness", "rmse", "correspondences", "matrix", "information", "shift", "turn", "reason"])
            yield frame.astype({"correspondences": "Int64"})

    return pairs.select("pair_id", "source", "target", start.alias("start")).mapInPandas(run, schema)


def _angles(p: tuple, n: tuple, q: tuple, m: tuple, d: Column) -> tuple[Column, Column, Column]:
    """Angles between two oriented points: across, along, and around (radians), in the frame of the first."""
    way = tuple(x / d for x in minus(q, p))
    v = unit(cross(way, n))
    w = cross(n, v)
    return dot(v, m), dot(n, way), F.atan2(dot(w, m), dot(n, m))


def features(oriented: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Fast point feature histograms: keys, point_id and feature, three groups of BINS shares that sum to 100.

    oriented: keys, point_id, x, y, z, nx, ny, nz. A point's own histogram counts the angles to its neighbours within radius, which a grid join finds; the
    feature adds its neighbours' histograms, weighted by the inverse square of the distance. Points without neighbours are left out.
    """
    row = oriented.select(*keys, "point_id", "x", "y", "z", "nx", "ny", "nz")
    apart = F.col("a.point_id") != F.col("b.point_id")
    met = spatial.within(row, row, points.AXES, radius, keys, extra=apart & (F.col("distance") > 0))
    place = lambda s: tuple(F.col(f"{s}.{c}") for c in "xyz")
    normal = lambda s: tuple(F.col(f"{s}.n{c}") for c in "xyz")
    across, along, around = _angles(place("a"), normal("a"), place("b"), normal("b"), F.col("distance"))
    binned = lambda x, low, high: F.coalesce(F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * BINS))), F.lit(BINS // 2)).cast("int")
    own = [F.col(f"a.{k}").alias(k) for k in keys]
    told = met.select(*own, F.col("a.point_id").alias("point_id"), F.col("b.point_id").alias("other"), "distance", binned(around, -np.pi, np.pi).alias("b0"), binned(across, -1.0, 1.0).alias("b1"), binned(along, -1.0, 1.0).alias("b2"))
    told = cut(told)
    share = [(100 * F.count_if(F.col(f"b{g}") == i) / F.count(F.lit(1))).alias(f"h{g * BINS + i}") for g in range(3) for i in range(BINS)]
    own = cut(told.groupBy(*keys, "point_id").agg(*share))
    names = [f"h{i}" for i in range(3 * BINS)]
    weight = 1 / (F.col("distance") * F.col("distance"))
    around = told.join(own.withColumnRenamed("point_id", "other"), [*keys, "other"]).groupBy(*keys, "point_id")
    around = around.agg(*[(F.sum(F.col(h) * weight) / F.sum(weight)).alias(f"w{h}") for h in names])
    both = own.join(around, [*keys, "point_id"])
    return both.select(*keys, "point_id", F.array(*[(F.col(h) + F.col(f"w{h}")) / 2 for h in names]).alias("feature"))


def _matches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places that are each other's nearest in feature space; rows of b are met in blocks."""
    to_b, d_b = np.zeros(len(a), np.int64), np.full(len(a), np.inf)
    to_a, d_a = np.zeros(len(b), np.int64), np.full(len(b), np.inf)
    for at in range(0, len(b), 1024):
        part = b[at : at + 1024]
        d = (a**2).sum(axis=1)[:, None] + (part**2).sum(axis=1) - 2 * a @ part.T
        k, near = d.argmin(axis=1), d.min(axis=1)
        better = near < d_b
        to_b[better], d_b[better] = at + k[better], near[better]
        to_a[at : at + len(part)], d_a[at : at + len(part)] = d.argmin(axis=0), d.min(axis=0)
    mine = np.flatnonzero(to_a[to_b] == np.arange(len(a)))
    return np.column_stack([mine, to_b[mine]])


def registered_rooms(cloud: DataFrame, pairs: DataFrame, key: str, voxel: float = 0.10, tries: int = 50_000) -> DataFrame:
    """Rigid motions between rooms that share some of their surface, without a start: source, target, accepted, reason, fitness, rmse, matrix.

    cloud: key, point_id (of its own in the whole table), x, y, z. pairs: source, target, both values of key. Rooms are thinned to voxels, whose normals face the middle of the room;
    features match them, random triples find a start, and points on planes refine it on the voxels. Refused: 'insufficient_cloud_points' under
    LEAST_ROOM_POINTS points, 'no_common_triples', 'weak_shared_geometry'. A pair of rooms is one task's work, normals and features included, and a room's voxels are bounded by
    its surface: only they reach the pair, since neighbours by joins are hundreds of rows a voxel.
    """
    sound_point = F.lit(True)
    for c in "xyz":
        sound_point = sound_point & F.col(c).isNotNull() & ~F.isnan(c)
    # one shuffle of coordinates by room; voxels and their arrays need no other
    thin = points.voxels(spread(cloud.select(key, *[F.col(c).cast("double").alias(c) for c in "xyz"]), [key]), voxel, [key])
    gathered = thin.groupBy(key).agg(F.sum("n_points").alias("n"), F.sort_array(F.collect_list(F.when(sound_point, F.struct("x", "y", "z")))).alias("_p"))
    rooms = cut(gathered.select(key, "n", *[F.col("_p")[c].alias(f"_{c}") for c in "xyz"]))
    kind = dict(cloud.dtypes)[key]
    named = ["n", "_x", "_y", "_z"]
    side = lambda s: rooms.select(F.col(key).alias(s), *[F.col(c).alias(f"{s}{c}") for c in named])
    asked = pairs.select("source", "target").distinct().join(side("source"), "source", "left").join(side("target"), "target", "left")
    enough = (F.coalesce("sourcen", F.lit(0)) >= LEAST_ROOM_POINTS) & (F.coalesce("targetn", F.lit(0)) >= LEAST_ROOM_POINTS)
    schema = f"source {kind}, target {kind}, accepted boolean, reason string, fitness double, rmse double, matrix array<double>"

    def one(s: str, t: str, a: np.ndarray, b: np.ndarray) -> tuple:
        (a, _, fa), (b, n, fb) = (clouds.described(p, 2 * voxel, 5 * voxel, BINS) for p in (a, b))
        fit, rmse, matrix, reason = 0.0, None, None, "no_common_triples"
        start = clouds.by_features(a, b, _matches(fa, fb), 1.5 * voxel, tries) if len(a) and len(b) else None
        if start is not None:
            move, partner, distance = clouds.aligned(a, b, n, start, voxel)
            met = partner >= 0
            fit, rmse, matrix = float(met.mean()), float(np.sqrt((distance[met] ** 2).mean())) if met.any() else 0.0, move.ravel().tolist()
            reason = None if fit >= LEAST_FITNESS and rmse <= MOST_RMSE else "weak_shared_geometry"
        return s, t, reason is None, reason, fit, rmse, matrix

    def run(batches):
        for pdf in batches:
            place = lambda s: [np.column_stack(p) for p in zip(*(pdf[f"{s}_{c}"] for c in "xyz"))]  # noqa: E731, B023
            out = [one(*k) for k in zip(pdf["source"], pdf["target"], place("source"), place("target"))]
            yield pd.DataFrame(out, columns=["source", "target", "accepted", "reason", "fitness", "rmse", "matrix"])

    found = spread(asked.filter(enough).select("source", "target", *[f"{s}_{c}" for s in ("source", "target") for c in "xyz"]), ["source", "target"]).mapInPandas(run, schema)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    few = asked.filter(~enough).select("source", "target", F.lit(False).alias("accepted"), F.lit("insufficient_cloud_points").alias("reason"), F.lit(0.0).alias("fitness"), none("rmse", "double"), none("matrix", "array<double>"))
    return found.unionByName(few)
