"""Metric scale of sparse reconstructions from depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 15


def depth_ratios(points: DataFrame, poses: DataFrame, depth: DataFrame) -> DataFrame:
    """Ratios of measured to reconstructed depth of tracked points.

    points: point_id, x, y, z, track (array of keyframe ids); poses: keyframe_id, r (row-major 9), t (3), fx, fy, cx, cy;
    depth: keyframe_id, u, v, metres. Pixels are rounded half to even.
    """
    seen = points.select("point_id", "x", "y", "z", F.explode("track").alias("keyframe_id")).join(poses, "keyframe_id")
    row = lambda i: F.col("r")[3 * i] * F.col("x") + F.col("r")[3 * i + 1] * F.col("y") + F.col("r")[3 * i + 2] * F.col("z") + F.col("t")[i]
    camera = seen.withColumns({"_x": row(0), "_y": row(1), "_z": row(2)}).filter(F.col("_z") > 0.05)
    pixel = camera.withColumns({"u": F.bround(F.col("fx") * F.col("_x") / F.col("_z") + F.col("cx")).cast("int"), "v": F.bround(F.col("fy") * F.col("_y") / F.col("_z") + F.col("cy")).cast("int")})
    joined = pixel.join(depth, ["keyframe_id", "u", "v"]).filter(F.col("metres").between(0.20, 6.50)).withColumn("ratio", F.col("metres") / F.col("_z"))
    return joined.filter(F.col("ratio").between(0.01, 100)).select("point_id", "keyframe_id", "ratio")


def robust_scale(ratios: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Median of the ratios within 2.5 scaled MADs of the median, with inlier share, relative spread and status.

    Under LEAST ratios the scale is 1 and FAILED.
    """
    wanted = list(keys) or ["_all"]
    rows = ratios if keys else ratios.withColumn("_all", F.lit(1))
    first = rows.groupBy(*wanted).agg(F.median("ratio").alias("_m"), F.count("ratio").alias("n"))
    marked = rows.join(first, wanted)
    mad = marked.groupBy(*wanted).agg(F.greatest(F.lit(1e-5), 1.4826 * F.median(F.abs(F.col("ratio") - F.col("_m")))).alias("_mad"))
    kept = marked.join(mad, wanted).filter(F.abs(F.col("ratio") - F.col("_m")) <= 2.5 * F.col("_mad"))
    fit = kept.groupBy(*wanted).agg(F.median("ratio").alias("_s"), F.count("ratio").alias("inliers"), F.stddev_pop("ratio").alias("_d"))
    table = first.join(fit, wanted, "left")
    share, spread = F.col("inliers") / F.col("n"), F.col("_d") / F.col("_s")
    few = F.col("n") < LEAST
    status = F.when(few, "FAILED").when((spread <= 0.10) & (share >= 0.70), "GOOD").when((spread <= 0.25) & (share >= 0.50), "PROVISIONAL").otherwise("FAILED")
    return table.select(*keys, F.when(few, 1.0).otherwise(F.col("_s")).alias("scale"), "n", F.coalesce("inliers", F.lit(0)).alias("inliers"), F.when(~few, share).alias("inlier_share"), F.when(~few, spread).alias("uncertainty"), status.alias("status"))


def applied(poses: DataFrame, scales: DataFrame, key: str) -> DataFrame:
    """poses with t scaled to metres; rotations stay."""
    return poses.join(scales.select(key, "scale"), key).withColumns({"t": F.transform("t", lambda x: x * F.col("scale")), "is_metric": F.lit(True)}).drop("scale")
