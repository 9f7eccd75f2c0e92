"""Openings: sanity gates, association with walls, clustering over views, quality audit and fusion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.functions.gates import first_reason, reasons
from planimetra.functions.plan import segment_distance
from planimetra.functions.uncertainty import NORMAL_95
from planimetra.operators.grouped import labelled
from planimetra.operators.shared import spread


def sane(candidates: DataFrame) -> DataFrame:
    """Adds reason (null for sound ones) from x1..y2, width, height, label, left_clipped, right_clipped, depth_step."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return candidates.withColumn(
        "reason",
        first_reason(
            fills_frame=w * h > 0.65 * F.col("width") * F.col("height"), door_too_wide=(F.col("label") == "door") & (w > 1.5 * h), no_jamb_seen=F.col("left_clipped") & F.col("right_clipped") & ~F.col("depth_step"),
        ),
    )


def _strips(walls: DataFrame, reach: float, size: float) -> DataFrame:
    """Walls (x1, z1, x2, z2) once for each cell (_gx, _gz) of a grid of size that a place within reach of them may be in."""
    edge = reach + 1e-6
    x1, z1, x2, z2 = (F.col(c) for c in ("x1", "z1", "x2", "z2"))
    column = walls.withColumn("_gx", F.explode(F.sequence(F.floor((F.least(x1, x2) - edge) / size), F.floor((F.greatest(x1, x2) + edge) / size))))
    # the part of the wall that is over this column and reach beside it
    low, high = (F.col("_gx") * size - edge, (F.col("_gx") + 1) * size + edge)
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x1) / F.nullif(x2 - x1, F.lit(0.0))))
    over = [F.when(x1 == x2, z).otherwise(z1 + at(x) * (z2 - z1)) for x, z in ((low, z1), (high, z2))]
    ends = F.floor((F.least(*over) - edge) / size), F.floor((F.greatest(*over) + edge) / size)
    return column.withColumn("_gz", F.explode(F.sequence(*ends)))


def to_walls(openings: DataFrame, walls: DataFrame, keys: list[str], farthest: float = 0.45, least: float = 0.45, most: float = 2.60) -> DataFrame:
    """The wall of each opening (opening_id, x, z, width, score) with the best score * max(0.1, 1 - distance / farthest).

    walls: wall_id, ord, x1, z1, x2, z2. Of equal walls the first in ord wins. Openings meet the walls of their own cell of a grid, and a group of keys is as many tasks' work
    as it has cells.
    """
    size = 2 * farthest
    fits = openings.filter(F.col("width").between(least, most)).select(*keys, "opening_id", "x", "z", "score", F.floor(F.col("x") / size).alias("_gx"), F.floor(F.col("z") / size).alias("_gz"))
    celled = _strips(walls.select(*keys, "wall_id", "ord", "x1", "z1", "x2", "z2"), farthest, size)
    joined = spread(fits, [*keys, "_gx", "_gz"]).join(spread(celled, [*keys, "_gx", "_gz"]), [*keys, "_gx", "_gz"])
    d = segment_distance(F.col("x"), F.col("z"), F.col("x1"), F.col("z1"), F.col("x2"), F.col("z2"), 1e-6)
    near = joined.withColumn("distance", d).filter(F.col("distance") <= farthest)
    value = F.col("score") * F.greatest(F.lit(0.1), 1 - F.col("distance") / farthest)
    best = near.groupBy(*keys, "opening_id").agg(F.max(F.struct(value.alias("value"), (-F.col("ord")).alias("o"), "wall_id", "distance")).alias("m"))
    return best.select(*keys, "opening_id", "m.wall_id", "m.distance", F.col("m.value").alias("value"))


def clusters(observations: DataFrame, keys: list[str], reach: float = 0.75) -> DataFrame:
    """Adds cluster: observations (ord, x, z) of a wall and class join the nearest running centre within reach, else start one."""

    def label(places: np.ndarray) -> list[int]:
        sums, counts, out = [], [], []
        for p in places:
            far = [float(np.linalg.norm(s / n - p)) for s, n in zip(sums, counts)]
            k = int(np.argmin(far)) if far else -1
            if k < 0 or far[k] >= reach:
                sums.append(np.zeros(2))
                counts.append(0)
                k = len(sums) - 1
            sums[k] = sums[k] + p
            counts[k] += 1
            out.append(k)
        return out

    return labelled(observations, keys, "ord", ["x", "z"], label, "cluster")


def with_spread(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Adds median and mad of width over each cluster, in two passes of equal partitioning."""
    median = observations.groupBy(*keys).agg(F.median("width").alias("median"))
    joined = observations.join(median, keys)
    mad = joined.groupBy(*keys).agg(F.median(F.abs(F.col("width") - F.col("median"))).alias("mad"))
    return joined.join(mad, keys)


def audited(observations: DataFrame) -> DataFrame:
    """Adds reasons, high_quality and quality from cos, sharpness, left_clipped, right_clipped, distance, width, median, mad."""
    left, right = F.col("left_clipped"), F.col("right_clipped")
    found = reasons(
        camera_too_oblique=F.col("cos") < 0.60, blurry_frame=F.col("sharpness") < 80, both_jambs_clipped_outside_image=left & right, left_jamb_clipped_outside_image=left & ~right,
        right_jamb_clipped_outside_image=right & ~left, excessive_camera_distance=F.col("distance") > 4.5,
        extreme_deviation_from_median=F.abs(F.col("width") - F.col("median")) > F.greatest(F.lit(0.18), 2.2 * F.col("mad")),
    )
    quality = F.greatest(F.lit(0.1), 1 - 0.25 * F.size("reasons")) * (F.col("sharpness") / 200.0) * F.col("cos")
    return observations.withColumn("reasons", found).withColumns({"high_quality": F.size("reasons") == 0, "quality": F.round(quality, 4)})


def width_interval(values: DataFrame, keys: list[str], wall_rmse: float = 0.015, depth: float = 0.01) -> DataFrame:
    """Median width with a half interval of 1.96 root sum of squares, 0.015 at least, and a lower bound of 0.10 at least."""
    sem = F.when(F.count("width") > 1, F.stddev_samp("width") / F.sqrt(F.count("width"))).otherwise(0.025)
    half = F.greatest(F.lit(0.015), NORMAL_95 * F.sqrt(sem * sem + wall_rmse**2 + depth**2))
    table = values.groupBy(*keys).agg(F.median("width").alias("width"), half.alias("half"), F.count("width").alias("n"))
    return table.select(*keys, "width", F.greatest(F.lit(0.10), F.col("width") - F.col("half")).alias("lower"), (F.col("width") + F.col("half")).alias("upper"), "n")


def fused(audits: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """One opening a cluster: the median width of high-quality observations or, without any, of the better half by quality."""
    window = Window.partitionBy(*keys)
    rank = F.row_number().over(window.orderBy(F.desc("quality"), tie))
    n, good = F.count(F.lit(1)).over(window), F.sum(F.col("high_quality").cast("int")).over(window)
    table = audits.withColumns({"_rank": rank, "_n": n, "_good": good})
    used = table.filter(F.when(F.col("_good") > 0, F.col("high_quality")).otherwise(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2))))
    interval = width_interval(used, keys)
    counts = audits.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count_if("high_quality").alias("high_quality"))
    status = F.when((F.col("frames") >= 3) & (F.col("high_quality") >= 1), "accepted").when(F.col("frames") >= 2, "provisional").otherwise("uncertain")
    return interval.join(counts, keys).withColumn("status", status)


def depth_edges(columns: DataFrame, keys: list[str], jump: float = 0.12, trigger: float = 0.15) -> DataFrame:
    """First and last position of an opening in a depth band (pos, depth): null depths are carried forward, a step of jump starts it."""
    order = Window.partitionBy(*keys).orderBy("pos")
    median = columns.groupBy(*keys, "pos").agg(F.median("depth").alias("depth"))
    filled = median.withColumn("depth", F.last("depth", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    step = filled.withColumn("step", F.col("depth") - F.lag("depth").over(order))
    return step.groupBy(*keys).agg(
        F.min(F.when(F.col("step") > jump, F.col("pos"))).alias("left"), F.max(F.when(F.col("step") < -jump, F.col("pos"))).alias("right"), (F.max(F.abs("step")) >= trigger).alias("triggered")
    )
