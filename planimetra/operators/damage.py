"""Damage observations: projection to surfaces, metric extents and fusion over views."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.functions import shapes
from planimetra.functions.plan import ray_hit
from planimetra.functions.vectors import clipped
from planimetra.operators.grouped import labelled
from planimetra.operators.shared import spread

LINEAR = ("surface_crack", "crack_structural")


def host_planes(rays: DataFrame, planes: DataFrame, nearest=0.10, farthest=8.0, grazing=0.08, support=0.5) -> DataFrame:
    """The plane of each mask (mask_id) that most of its rays (ox..oz, dx..dz) hit, if at least support of them do.

    rays and planes (plane_id, ord, a, b, c, d) have capture_id, and planes are a few surfaces of a capture. Ties go to the first in ord. Masks of a capture
    with the same rays are met with its planes once.
    """
    way = [f"{s}{c}" for s in "od" for c in "xyz"]
    masks = rays.filter("capture_id is not null").groupBy("mask_id", "capture_id").agg(F.sort_array(F.collect_list(F.struct(*way))).alias("_rays"))
    distinct = masks.select("capture_id", "_rays").distinct()
    hit = lambda r: ray_hit(tuple(r[f"o{c}"] for c in "xyz"), tuple(r[f"d{c}"] for c in "xyz"), tuple(F.col(c) for c in "abcd"), nearest, farthest, grazing)
    hits = F.size(F.filter("_rays", lambda r: hit(r).isNotNull())).cast("long")
    met = distinct.join(planes, "capture_id").select("capture_id", "_rays", "plane_id", "ord", hits.alias("hits")).filter("hits > 0")
    best = met.groupBy("capture_id", "_rays").agg(F.max(F.struct("hits", (-F.col("ord")).alias("o"), "plane_id")).alias("m"))
    found = masks.join(best, ["capture_id", "_rays"]).select("mask_id", "m.plane_id", "m.hits", F.size("_rays").cast("long").alias("rays"))
    return found.filter(F.col("hits") >= support * F.col("rays"))


def extent_status(rows: DataFrame) -> DataFrame:
    """uncertainty, status and reason from n_points, angle, clipped, plane_rmse, metric, largest, smallest."""
    cos = F.greatest(F.lit(0.20), F.cos(F.radians("angle")))
    relative = clipped(0.08 + 0.15 * (1 / cos - 1) + F.when(F.col("clipped"), 0.35).otherwise(0.0) + F.least(F.lit(0.25), 5 * F.col("plane_rmse")), 0.08, 0.85)
    reason = (
        F.when(~F.col("metric") | (F.col("n_points") < 3), "uncalibrated_or_too_few_points").when(F.col("angle") > 75, "extreme_angle")
    )
    doubtful = F.col("clipped") | (F.col("angle") > 60) | (relative > 0.35)
    status = F.when(reason.isNotNull(), "NOT_EVALUABLE").when(doubtful, "PROVISIONAL").otherwise("ACCEPTED")
    return rows.withColumns({"uncertainty": F.when(reason.isNotNull(), 1.0).otherwise(relative), "status": status, "reason": reason})


def area_extents(points: DataFrame, key: str) -> DataFrame:
    """Convex-hull area of each mask's surface points (u, v); 0.7 of their box where the hull is flat."""

    def area(us: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for u, v in zip(us, vs):
            p = np.column_stack([np.asarray(u, float), np.asarray(v, float)])
            value = abs(shapes.signed_area(shapes.hull(p)))
            out.append(value if value > 0 else 0.7 * float(np.prod(p.max(axis=0) - p.min(axis=0))))
        return pd.Series(out, dtype=float)

    # many masks to an Arrow batch: a group of its own would cost more than its hull
    packed = spread(points.select(key, F.struct(F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")).alias("_p")), [key]).groupBy(key).agg(F.collect_list("_p").alias("_p"))
    axis = lambda c: F.transform("_p", lambda p: p[c])
    return packed.select(key, F.pandas_udf(area, "double")(axis("u"), axis("v")).alias("area"), F.size("_p").cast("long").alias("n_points"))


def linear_extents(points: DataFrame, key: str) -> DataFrame:
    """Range of each mask's points (u, v) along their main axis, from the closed form of a 2x2 covariance."""
    moments = points.groupBy(key).agg(F.var_pop("u").alias("a"), F.var_pop("v").alias("c"), F.covar_pop("u", "v").alias("b"))
    angle = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))
    along = F.col("u") * F.cos("_t") + F.col("v") * F.sin("_t")
    return points.join(moments.select(key, angle.alias("_t")), key).groupBy(key).agg((F.max(along) - F.min(along)).alias("length"), F.count(F.lit(1)).alias("n_points"))


def clusters(observations: DataFrame, radius: float = 0.35) -> DataFrame:
    """Adds cluster: observations of a surface within radius of a seed, seeds being taken in order of ord.

    A later observation belongs to the first seed that reaches it, so each (capture, surface) is one ordered group.
    """
    def label(p: np.ndarray) -> list[int]:
        out, count = np.full(len(p), -1), 0
        for i in range(len(p)):
            if out[i] < 0:
                out[(out < 0) & (np.linalg.norm(p - p[i], axis=1) <= radius)] = count
                out[i] = count
                count += 1
        return out.tolist()

    return labelled(observations, ["capture_id", "surface_id"], "ord", ["x", "y", "z"], label, "cluster")


def fused(observations: DataFrame, keys: list[str]) -> DataFrame:
    """One region a cluster: class by summed confidence (the earliest of equals), weighted centre, best view, mean area and status.

    observations: keys.., ord, observation_id, damage_class, confidence, x, y, z, angle, area, lower, upper, status.
    """
    votes = observations.groupBy(*keys, "damage_class").agg(F.sum("confidence").alias("v"), F.min("ord").alias("first"))
    winner = votes.groupBy(*keys).agg(F.max(F.struct(F.round("v", 9).alias("v"), (-F.col("first")).alias("f"), "damage_class")).alias("m")).select(*keys, F.col("m.damage_class").alias("damage_class"))
    weight = F.sum("confidence")
    has = lambda s: F.count_if(F.col("status") == s)
    n = F.count(F.lit(1))
    status = F.when(has("ACCEPTED") > 0, "ACCEPTED").when(has("NOT_EVALUABLE") == n, "NOT_EVALUABLE").when(has("PROVISIONAL") > 0, "PROVISIONAL").otherwise("UNCERTAIN")
    table = observations.groupBy(*keys).agg(
        n.alias("n_observations"), F.round(F.avg("confidence"), 3).alias("confidence"), *[F.round(F.sum(F.col(c) * F.col("confidence")) / F.nullif(weight, F.lit(0.0)), 4).alias(c) for c in "xyz"],
        F.min_by("observation_id", F.struct("angle", "ord")).alias("best_observation"), F.round(F.avg("area"), 3).alias("area"), F.round(F.stddev_pop("area"), 4).alias("spread"),
        F.round(F.avg("lower"), 3).alias("lower"), F.round(F.avg("upper"), 3).alias("upper"), status.alias("status"),
    )
    return table.join(winner, keys)


def image_gate(images: DataFrame) -> DataFrame:
    """USABLE, PROVISIONAL or REJECTED of images from width, height, mean, contrast and laplacian, with reasons."""
    from planimetra.functions.gates import reasons

    hard = reasons(too_small=(F.col("width") < 64) | (F.col("height") < 64), too_dark=F.col("mean") < 20, too_bright=F.col("mean") > 240, low_contrast=F.col("contrast") < 12, blurred=F.col("laplacian") < 5)
    soft = reasons(soft_focus=F.col("laplacian") < 15)
    return images.withColumns({"reasons": F.concat(hard, F.when(F.size(hard) == 0, soft).otherwise(F.array().cast("array<string>")))}).withColumn("status", F.when(F.size(hard) > 0, "REJECTED").when(F.size(soft) > 0, "PROVISIONAL").otherwise("USABLE"))
