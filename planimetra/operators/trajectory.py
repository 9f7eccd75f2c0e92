"""Trajectories: steps, statistics, revisits, loop candidates, keyframes, interpolation and drift."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.functions.gates import reasons
from planimetra.operators import spatial

AXES = ["x", "y", "z"]


def _order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("ts_s", "frame")


def numbered(poses: DataFrame, key: str, tie: str) -> DataFrame:
    """Adds frame, from 0, in order of time."""
    return poses.withColumn("frame", F.row_number().over(Window.partitionBy(key).orderBy("ts_s", tie)) - 1)


def steps(poses: DataFrame, key: str) -> DataFrame:
    """Adds step, the distance to the pose before; null for the first."""
    square = F.lit(0.0)
    for c in AXES:
        d = F.col(c) - F.lag(c).over(_order(key))
        square = square + d * d
    return poses.withColumn("step", F.sqrt(square))


def statistics(poses: DataFrame, key: str, loop: bool = False) -> DataFrame:
    """Per trajectory: frames, path length, displacement, duration, mean speed, bounds; loop_drift only where a loop is claimed."""
    first, last = F.struct("ts_s", "frame"), F.struct("ts_s", "frame")
    ends = [f(F.struct(*AXES), o).alias(n) for f, o, n in ((F.min_by, first, "start"), (F.max_by, last, "end"))]
    box = [g(c).alias(f"{c}_{n}") for c in AXES for g, n in ((F.min, "min"), (F.max, "max"))]
    table = steps(poses, key).groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"), (F.max("ts_s") - F.min("ts_s")).alias("duration"), *ends, *box)
    square = F.lit(0.0)
    for c in AXES:
        square = square + (F.col(f"end.{c}") - F.col(f"start.{c}")) * (F.col(f"end.{c}") - F.col(f"start.{c}"))
    table = table.withColumn("displacement", F.sqrt(square)).withColumn("speed", F.when(F.col("duration") > 0, F.col("path_length") / F.col("duration")).otherwise(0.0))
    return table.withColumn("loop_drift", F.col("displacement") if loop else F.lit(None).cast("double")).drop("start", "end")


def gaps(poses: DataFrame, key: str) -> DataFrame:
    """Per trajectory: the largest gap between neighbours in time."""
    gap = F.col("ts_s") - F.lag("ts_s").over(_order(key))
    return poses.withColumn("_gap", gap).groupBy(key).agg(F.max("_gap").alias("largest_gap"), F.min("ts_s").alias("from_s"), F.max("ts_s").alias("to_s"))


def thinned(poses: DataFrame, key: str, most: int = 400) -> DataFrame:
    """Every (n // most)-th frame of a trajectory of n."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return poses.withColumn("_n", n).filter(F.col("frame") % F.greatest(F.lit(1), F.floor(F.col("_n") / most)) == 0).drop("_n")


def revisits(poses: DataFrame, key: str, radius: float = 0.8, least_seconds: float = 20.0) -> DataFrame:
    """Pairs of frames of a trajectory at one place again, far enough apart in time."""
    later = (F.col("b.frame") > F.col("a.frame")) & (F.col("b.ts_s") - F.col("a.ts_s") >= least_seconds)
    pairs = spatial.within(poses.select(key, "frame", "ts_s", *AXES), poses.select(key, "frame", "ts_s", *AXES), AXES, radius, [key], later)
    return pairs.select(F.col(f"a.{key}").alias(key), F.col("a.frame").alias("frame"), F.col("b.frame").alias("later_frame"), (F.col("b.ts_s") - F.col("a.ts_s")).alias("seconds"), "distance")


def loop_candidates(nodes: DataFrame, key: str, radius: float = 1.6, least_nodes: int = 12, least_seconds: float = 18.0, most: int = 30) -> DataFrame:
    """The nearest pairs of keyframes (key, node, ts_s, x, y, z) that may close a loop, most of each trajectory."""
    far = (F.col("b.node") - F.col("a.node") >= least_nodes) & (F.col("b.ts_s") - F.col("a.ts_s") >= least_seconds)
    found = spatial.within(nodes, nodes, AXES, radius, [key], far).select(
        F.col(f"a.{key}").alias(key), F.col("a.node").alias("source"), F.col("b.node").alias("target"), (F.col("b.ts_s") - F.col("a.ts_s")).alias("seconds"), "distance"
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "source", "target"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def validated_loops(loops: DataFrame, fitness=0.55, rmse=0.055, correspondences=80, shift=0.50, turn=22.0) -> DataFrame:
    """Adds reasons and decision: accepted without reasons; uncertain if the shifts are sound and the fit nearly so."""
    found = reasons(
        low_fitness=F.col("fitness") < fitness, high_rmse=F.col("rmse") > rmse, few_correspondences=F.col("correspondences") < correspondences,
        large_translation=F.col("shift") > shift, large_rotation=F.col("turn") > turn,
    )
    nearly = (F.col("shift") <= shift) & (F.col("turn") <= turn) & (F.col("fitness") >= 0.45) & (F.col("rmse") <= 1.3 * rmse)
    decided = F.when(F.size("reasons") == 0, "accepted").when(nearly, "uncertain").otherwise("rejected")
    return loops.withColumn("reasons", found).withColumn("decision", decided)


def odometry_edges(nodes: DataFrame, key: str) -> DataFrame:
    """Consecutive nodes of a trajectory with their distance and time between."""
    order = Window.partitionBy(key).orderBy("node")
    square = F.lit(0.0)
    for c in AXES:
        d = F.lead(c).over(order) - F.col(c)
        square = square + d * d
    table = nodes.select(key, F.col("node").alias("source"), F.lead("node").over(order).alias("target"), F.sqrt(square).alias("distance"), (F.lead("ts_s").over(order) - F.col("ts_s")).alias("seconds"))
    return table.filter("target is not null")


def _selected(pdf: pd.DataFrame, metres: float, degrees: float, frames: int, tail: int) -> np.ndarray:
    p = pdf[AXES].to_numpy(float)
    q = pdf[["qx", "qy", "qz", "qw"]].to_numpy(float)
    number = pdf["frame"].to_numpy()
    kept, least_cosine = [0], np.cos(np.radians(degrees) / 2)
    for i in range(1, len(pdf)):
        last = kept[-1]
        (a, b, c, d), (e, f, g, h) = q[i], q[last]  # summed in order, so that every machine agrees
        if np.linalg.norm(p[i] - p[last]) >= metres or abs(a * e + b * f + c * g + d * h) <= least_cosine or number[i] - number[last] >= frames:
            kept.append(i)
    if number[-1] - number[kept[-1]] > tail:
        kept.append(len(pdf) - 1)
    return np.array(kept)


def keyframes(poses: DataFrame, key: str, metres: float = 0.45, degrees: float = 18.0, frames: int = 150, tail: int = 10) -> DataFrame:
    """Poses that moved, turned or waited enough since the last kept one, and the last if it is tail frames later; with node from 0.

    Each choice depends on the one before, so a trajectory is folded in order, one group a trajectory.
    """
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts_s", "frame"]).reset_index(drop=True)
        out = pdf.iloc[_selected(pdf, metres, degrees, frames, tail)].copy()
        out["node"] = np.arange(len(out), dtype=np.int64)
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in poses.schema.fields)
    return poses.groupBy(key).applyInPandas(fold, f"{fields}, node long")


def window_keyframes(frames: DataFrame, key: str, windows: int = 60) -> DataFrame:
    """The sharpest frame, near the middle, of each of at most windows equal parts of a video; the first keeps its first frame.

    frames: frame (from 0), sharpness, exposed. A badly exposed frame counts a tenth.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    table = frames.withColumn("_n", n).withColumn("_w", F.least(F.lit(windows), F.col("_n")))
    table = table.withColumn("window", F.floor(F.col("frame") * F.col("_w") / F.col("_n")).cast("int")).withColumn("_span", F.col("_n") / F.col("_w"))
    sigma = F.greatest(F.lit(5.0), 0.35 * F.col("_span"))
    off = (F.col("frame") - (F.col("window") + 0.5) * F.col("_span")) / sigma
    score = F.col("sharpness") * F.when(F.col("exposed"), 1.0).otherwise(0.1) * (0.3 + 0.7 * F.exp(-0.5 * off * off))
    score = F.when((F.col("window") == 0) & (F.col("frame") == 0), float("inf")).otherwise(score)
    best = table.withColumn("score", score).groupBy(key, "window").agg(F.max(F.struct(F.col("score"), (-F.col("frame")).alias("f"))).alias("m"))
    return best.select(key, "window", (-F.col("m.f")).alias("frame"))


def drift(raw: DataFrame, optimised: DataFrame, key: str) -> DataFrame:
    """Distance between the ends of each trajectory before and after optimisation, and the reduction in per cent."""
    gap = lambda df, name: statistics(df, key).select(key, F.col("displacement").alias(name))
    joined = gap(raw, "raw_gap").join(gap(optimised, "optimised_gap"), key)
    return joined.withColumn("reduction_pct", F.when(F.col("raw_gap") > 0, 100 * (F.col("raw_gap") - F.col("optimised_gap")) / F.col("raw_gap")))


def interpolated(poses: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """poses with dx, dy, dz of the keyframes around them, linear in the frame number and clamped at the ends.

    corrections: key, frame, dx, dy, dz. Both neighbours come from one window over frames, without a range join.
    """
    names = ["dx", "dy", "dz"]
    marked = poses.join(corrections.select(key, "frame", F.struct(F.col("frame").cast("double").alias("f"), *names).alias("_k")), [key, "frame"], "left")
    order = Window.partitionBy(key).orderBy("frame")
    before = F.last("_k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_k", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    table = marked.withColumns({"_a": F.coalesce(before, after), "_b": F.coalesce(after, before)})
    share = F.when(F.col("_b.f") > F.col("_a.f"), (F.col("frame") - F.col("_a.f")) / (F.col("_b.f") - F.col("_a.f"))).otherwise(0.0)
    mixed = {c: F.col(f"_a.{c}") + share * (F.col(f"_b.{c}") - F.col(f"_a.{c}")) for c in names}
    return table.withColumns(mixed).drop("_k", "_a", "_b")


def nodes_of_frames(frames: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """frames with the node of the keyframe that each is, null for others. nodes: key, node, frame."""
    return frames.join(nodes.select(key, "frame", "node"), [key, "frame"], "left")


def loop_residual(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean distance between where loop edges (source, target, dx, dy, dz) say their source is and where it is; 0 for none."""
    a = nodes.select(F.col("node").alias("source"), *[F.col(c).alias(f"s{c}") for c in AXES])
    b = nodes.select(F.col("node").alias("target"), *[F.col(c).alias(f"t{c}") for c in AXES])
    square = F.lit(0.0)
    for c in AXES:
        d = F.col(f"s{c}") - F.col(f"t{c}") - F.col(f"d{c}")
        square = square + d * d
    return edges.join(a, "source").join(b, "target").agg(F.coalesce(F.avg(F.sqrt(square)), F.lit(0.0)).alias("residual"), F.count(F.lit(1)).alias("loops"))


def camera_poses(solved: DataFrame) -> DataFrame:
    """solved with t_vec (an array) as x, y, z and a reason, 'no_camera_centre' where it has under three elements or is null."""
    whole = F.coalesce(F.size("t_vec") >= 3, F.lit(False))
    centre = {c: F.when(whole, F.get("t_vec", F.lit(i))) for i, c in enumerate(AXES)}
    return solved.withColumns({**centre, "reason": F.when(~whole, "no_camera_centre")}).drop("t_vec")


def with_poses(images: DataFrame, poses: DataFrame, key: str = "image") -> DataFrame:
    """images with position and quaternion (x, y, z, w) of the pose of their name, both null where either is missing.

    poses: key, position, quaternion_wxyz, one row a name.
    """
    w = F.col("quaternion_wxyz")
    whole = F.col("position").isNotNull() & w.isNotNull()
    turned = poses.select(key, F.when(whole, F.col("position")).alias("position"), F.when(whole, F.concat(F.slice(w, 2, 3), F.slice(w, 1, 1))).alias("quaternion"))
    return images.join(turned, key, "left")


def first_frames(frames: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """At most so many frames of each trajectory, in order; 0 keeps all."""
    if not most:
        return frames
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return frames.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")
