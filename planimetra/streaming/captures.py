"""Streaming forms of the capture counters and the keyframe fold."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_KEYFRAME = "trajectory_id long, frame int, ts_s double, x double, y double, z double, node long"
_STATE = "x double, y double, z double, qx double, qy double, qz double, qw double, frame int, node long"


def live_keyframes(poses: DataFrame, metres: float = 0.45, degrees: float = 18.0, frames: int = 150) -> DataFrame:
    """Keyframes of poses as they arrive (trajectory_id, frame, ts_s, x..z, qx..qw): the state is the last kept pose.

    Poses of a trajectory are taken in the order of time within each batch, and must not arrive later than that.
    """
    names = ["x", "y", "z", "qx", "qy", "qz", "qw"]

    def fold(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for row in pd.concat(list(parts)).sort_values(["ts_s", "frame"]).itertuples(index=False):
            pose = np.array([getattr(row, n) for n in names], float)
            if last is not None:
                before = np.array(last[:7], float)
                turn = np.degrees(2 * np.arccos(min(1.0, abs(float(pose[3:] @ before[3:])))))
                if np.linalg.norm(pose[:3] - before[:3]) < metres and turn < degrees and row.frame - last[7] < frames:
                    continue
            node = 0 if last is None else last[8] + 1
            last = (*map(float, pose), int(row.frame), int(node))
            out.append((key[0], int(row.frame), float(row.ts_s), *map(float, pose[:3]), int(node)))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=["trajectory_id", "frame", "ts_s", "x", "y", "z", "node"])

    return poses.groupBy("trajectory_id").applyInPandasWithState(fold, _KEYFRAME, _STATE, "append", GroupStateTimeout.NoTimeout)


def live_funnel(pixels: DataFrame, time: str = "ts", lateness: str = "10 minutes", window: str = "1 minute", least_confidence: int = 2, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Counters of a capture by window of event time; rows later than lateness are dropped."""
    sure = F.col("confidence") >= least_confidence
    return pixels.withWatermark(time, lateness).groupBy(F.window(time, window), "capture_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(sure).alias("confident"), F.count_if(sure & F.col("depth").between(low, high)).alias("in_range")
    )


def live_voxels(points: DataFrame, size: float, key: str = "capture_id") -> DataFrame:
    """Fused cloud of arriving points (key, view_id, x, y, z): per voxel its sums and its views so far, for output mode 'update'.

    The state is one row a voxel, held by Spark under the voxel's key; frames may arrive in any order and late ones count too. A point without coordinates or
    with one that is not finite counts for nothing, a null view for no view.
    """
    sound = F.lit(True)
    for c in "xyz":
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    grid = [F.floor(F.col(c) / size).cast("long").alias(f"v{c}") for c in "xyz"]
    return points.filter(sound).groupBy(key, *grid).agg(F.count(F.lit(1)).alias("n_points"), F.collect_set("view_id").alias("views"), *[F.sum(c).alias(f"sum_{c}") for c in "xyz"])


def closed_voxels(updates: DataFrame, key: str = "capture_id") -> DataFrame:
    """The cloud that the updates of live_voxels() end with: per voxel its last row as n_points, n_views and mean x, y, z. Repeated and reordered updates do no harm."""
    voxel = [key, "vx", "vy", "vz"]
    last = updates.groupBy(*voxel).agg(F.max_by(F.struct("n_points", "views", "sum_x", "sum_y", "sum_z"), "n_points").alias("_l"))
    return last.select(*voxel, "_l.n_points", F.size("_l.views").cast("long").alias("n_views"), *[(F.col(f"_l.sum_{c}") / F.col("_l.n_points")).alias(c) for c in "xyz"])
