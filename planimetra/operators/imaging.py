"""Frames, keyframes and sparse reconstructions: quality, registration and coverage gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.functions import pictures
from planimetra.functions.gates import reasons
from planimetra.operators import spatial


def exposed(mean: Column) -> Column:
    return mean.between(15, 245)


def photo_warnings(photos: DataFrame, similarities: DataFrame) -> DataFrame:
    """Adds advisory warnings to photos (photo_id, ord, sharpness, mean, dark and bright (shares of pixels), width, height).

    similarities: photo_id, other, value of pairs in which other comes earlier.
    """
    most = similarities.groupBy("photo_id").agg(F.max("value").alias("_like"))
    found = reasons(
        motion_blur_or_soft_focus=F.col("sharpness") < 35, severe_darkness=(F.col("mean") < 35) | (F.col("dark") > 0.55), severe_overexposure=(F.col("mean") > 225) | (F.col("bright") > 0.55),
        duplicate_viewpoint_likely=F.coalesce(F.col("_like") > 0.985, F.lit(False)), low_resolution=F.least("width", "height") < 720,
    )
    return photos.join(most, "photo_id", "left").withColumn("warnings", found).drop("_like")


def depth_quality(pixels: DataFrame, keys: list[str], steepest: float = 0.20, low: float = 0.20, high: float = 8.0) -> DataFrame:
    """Adds sound to depth pixels (u, v, depth): finite, in range, and with a small Sobel gradient for their depth.

    The eight neighbours come from windows over rows and columns, not from a self-join; at the border and beside a missing
    pixel the own depth stands in.
    """
    row, column = Window.partitionBy(*keys, "v").orderBy("u"), Window.partitionBy(*keys, "u").orderBy("v")
    own = F.col("depth")
    beside = lambda f, c, place, order: F.when(F.abs(f(place).over(order) - F.col(place)) == 1, f(c).over(order))
    left, right = (F.coalesce(beside(f, "depth", "u", row), own) for f in (F.lag, F.lead))
    table = pixels.withColumns({"_dx": right - left, "_sx": left + 2 * own + right})
    at = lambda f, c: F.coalesce(beside(f, c, "v", column), F.col(c))
    gx = at(F.lag, "_dx") + 2 * F.col("_dx") + at(F.lead, "_dx")
    gy = at(F.lead, "_sx") - at(F.lag, "_sx")
    finite = ~F.isnan(own) & (F.abs(own) < float("inf"))
    sound = finite & own.between(low, high) & (F.hypot(gx, gy) / 8 / own < steepest)
    return table.withColumn("sound", F.coalesce(sound, F.lit(False))).drop("_dx", "_sx")


def registration_gate(views: DataFrame, keys: list[str]) -> DataFrame:
    """Whether a video's registered views carry a multi-room plan: 20 views, 30 % of keyframes and of the time, no large gap.

    views: keys.., ts_s, registered, duration (of the whole video).
    """
    order = Window.partitionBy(*keys).orderBy("ts_s")
    total = views.groupBy(*keys).agg(F.count(F.lit(1)).alias("keyframes"), F.max("duration").alias("duration"))
    gaps = views.filter("registered").withColumn("_gap", F.col("ts_s") - F.lag("ts_s").over(order))
    seen = gaps.groupBy(*keys).agg(F.count(F.lit(1)).alias("registered"), (F.max("ts_s") - F.min("ts_s")).alias("_span"), F.max("_gap").alias("largest_gap"))
    table = total.join(seen, keys, "left").na.fill(0, ["registered"])
    table = table.withColumns({"ratio": F.col("registered") / F.col("keyframes"), "coverage": F.coalesce(F.col("_span") / F.nullif(F.col("duration"), F.lit(0.0)), F.lit(0.0))}).drop("_span")
    found = reasons(
        few_views=F.col("registered") < 20, low_ratio=F.col("ratio") < 0.30, low_coverage=F.col("coverage") < 0.30, large_gap=F.col("largest_gap") > F.greatest(F.lit(15.0), 0.2 * F.col("duration"))
    )
    return table.withColumn("reasons", found).withColumn("accepted", F.size("reasons") == 0)


def sfm_status(poses: DataFrame, keys: list[str]) -> DataFrame:
    """GOOD, PROVISIONAL or FAILED of reconstructions from poses (ord, x, y, z, error, total) with pose jumps and id gaps.

    Errors are summed in ord, so that a mean on a limit does not depend on how rows were dealt to tasks.
    """
    order = Window.partitionBy(*keys).orderBy("ord")
    square = F.lit(0.0)
    for c in "xyz":
        d = F.col(c) - F.lag(c).over(order)
        square = square + d * d
    table = poses.withColumns({"_step": F.sqrt(square), "_gap": F.col("ord") - F.lag("ord").over(order), "_errors": F.sum("error").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    median = table.groupBy(*keys).agg(F.median("_step").alias("_median"))
    out = table.join(median, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("registered"), (F.count(F.lit(1)) / F.max("total")).alias("ratio"), (F.max_by("_errors", "ord") / F.nullif(F.count("error"), F.lit(0))).alias("error"), F.count_if(F.col("_step") > 5 * F.col("_median")).alias("jumps"),
        F.count_if(F.col("_gap") > F.greatest(F.lit(3), F.ceil(0.2 * F.col("total")))).alias("gaps"),
    )
    good = (F.col("ratio") >= 0.5) & (F.col("error") <= 1.5)
    status = F.when(good & (F.col("jumps") == 0), "GOOD").when((F.col("registered") >= 3) & (F.col("error") <= 2.0), "PROVISIONAL").otherwise("FAILED")
    return out.withColumn("status", status)


def photo_configuration(count: Column) -> Column:
    """Exhaustive pairs of 2 to 8 photos; null for other counts."""
    return F.when(count.between(2, 8), (count * (count - 1) / 2).cast("int"))


def consecutive_links(frames: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Whether each frame and the next (frame, other) are verified."""
    following = F.lead("frame").over(Window.partitionBy(key).orderBy("frame"))
    pairs = frames.select(key, "frame", following.alias("other")).filter("other is not null")
    return pairs.join(verified.select(key, "frame", "other", F.lit(True).alias("_v")), [key, "frame", "other"], "left").select(key, "frame", "other", F.coalesce("_v", F.lit(False)).alias("linked"))


def upright(cameras: DataFrame, keys: list[str]) -> DataFrame:
    """Rotation (row-major 9) that takes the median up vector (ux, uy, uz) of cameras to +y, by Rodrigues' formula."""
    table = cameras.groupBy(*keys).agg(*[F.median(f"u{c}").alias(c) for c in "xyz"])
    n = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    unit = table.withColumns({c: F.col(c) / n for c in "xyz"})
    x, y, z = (F.col(c) for c in "xyz")
    k = 1 / F.nullif(1 + y, F.lit(0.0))  # axis (-z, 0, x): up x +y
    whole = F.array(1 - k * x * x, -x, -k * x * z, x, y, z, -k * x * z, -z, 1 - k * z * z)
    flipped = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)])
    return unit.select(*keys, F.when(1 + y > 1e-9, whole).otherwise(flipped).alias("rotation"))


def normals(points: DataFrame, key: str, radius: float = 0.10, neighbours: int = 30, keys: list[str] = ()) -> DataFrame:
    """Unit normals from the plane of each point's nearest neighbours; points with fewer than two are left out.

    Neighbours are found by the grid join, covariances summed in SQL, and only 3x3 eigenvectors are taken in Arrow batches.
    """
    near = spatial.nearest_among(points, ["x", "y", "z"], radius, neighbours, key, keys)
    joined = near.select(F.col(key), F.col("neighbour")).join(points.select(F.col(key).alias("neighbour"), "x", "y", "z"), "neighbour")
    moments = [F.covar_pop(a, b).alias(f"{a}{b}") for i, a in enumerate("xyz") for b in "xyz"[i:]]
    table = joined.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *moments).filter("n >= 2")

    def smallest(batches):
        for pdf in batches:
            m = np.array([[pdf["xx"], pdf["xy"], pdf["xz"]], [pdf["xy"], pdf["yy"], pdf["yz"]], [pdf["xz"], pdf["yz"], pdf["zz"]]]).transpose(2, 0, 1)
            v = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
            v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1, 1)[:, None] if len(v) else v
            yield pd.DataFrame({key: pdf[key], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2]})

    return table.mapInPandas(smallest, f"`{key}` {dict(points.dtypes)[key]}, nx double, ny double, nz double")


def merged_lines(lines: DataFrame, key: str, degrees: float = 8.0, offset: float = 0.15, gap: float = 0.35) -> DataFrame:
    """Merged wall lines (wall_id, a, b, c, start, end, inliers): most inliers first, a line joins the first kept one that is
    parallel, near and not far along it, whose line and ends it then moves by weight. One ordered group a capture.
    """
    schema = f"`{key}` {dict(lines.dtypes)[key]}, wall_id {dict(lines.dtypes)['wall_id']}, a double, b double, c double, start double, end double, inliers long, merged int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for r in pdf.sort_values(["inliers", "wall_id"], ascending=[False, True]).to_dict("records"):
            for k in kept:
                dot = k["a"] * r["a"] + k["b"] * r["b"]
                sign = 1.0 if dot >= 0 else -1.0
                low, high = sorted((sign * r["start"], sign * r["end"]))
                apart = max(0.0, low - k["end"], k["start"] - high)
                if abs(dot) >= np.cos(np.radians(degrees)) and abs(k["c"] - sign * r["c"]) <= offset and apart <= gap:
                    w, v = k["inliers"], r["inliers"]
                    line = np.array([k["a"], k["b"], k["c"]]) * w + sign * np.array([r["a"], r["b"], r["c"]]) * v
                    k["a"], k["b"], k["c"] = (line / np.hypot(*line[:2])).tolist()
                    k.update(start=min(k["start"], low), end=max(k["end"], high), inliers=w + v, merged=k["merged"] + 1)
                    break
            else:
                kept.append({**{c: r[c] for c in (key, "wall_id", "a", "b", "c", "start", "end", "inliers")}, "merged": 1})
        return pd.DataFrame(kept, columns=[key, "wall_id", "a", "b", "c", "start", "end", "inliers", "merged"])

    return lines.groupBy(key).applyInPandas(run, schema)


def photo_geometry(points: DataFrame, cameras: DataFrame, key: str) -> DataFrame:
    """Baseline over extent, occupancy of a 4x4 grid in the main plane and spread of steps, with reasons and status.

    points and cameras: key, x, y, z, cameras also ord; eigenvectors are taken per reconstruction of a few photos.
    """
    schema = f"`{key}` {dict(points.dtypes)[key]}, baseline double, occupancy double, diversity double"

    def run(k, cloud: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        p, c = cloud[["x", "y", "z"]].to_numpy(float), own.sort_values("ord")[["x", "y", "z"]].to_numpy(float)
        if len(p) < 3 or len(c) < 2:
            return pd.DataFrame([(k[0], 0.0, 0.0, 0.0)], columns=[key, "baseline", "occupancy", "diversity"])
        low, high = np.percentile(p, [5, 95], axis=0)
        extent = float(np.linalg.norm(high - low)) or 1.0
        axes = np.linalg.eigh(np.cov((p - p.mean(axis=0)).T))[1][:, 1:]
        q = (p - p.mean(axis=0)) @ axes
        span = np.maximum(np.ptp(q, axis=0), 1e-9)
        cells = {tuple(x) for x in np.minimum(3, ((q - q.min(axis=0)) / span * 4).astype(int))}
        steps = np.linalg.norm(np.diff(c, axis=0), axis=1)
        reach = float(np.linalg.norm(c.max(axis=0) - c.min(axis=0)))
        return pd.DataFrame([(k[0], reach / extent, min(1.0, len(cells) / 8), float(steps.std() / max(steps.mean(), 1e-9)))], columns=[key, "baseline", "occupancy", "diversity"])

    table = points.groupBy(key).cogroup(cameras.groupBy(key)).applyInPandas(run, schema)
    found = reasons(short_baseline=F.col("baseline") < 0.05, sparse_coverage=F.col("occupancy") < 0.5)
    return table.withColumn("reasons", found).withColumn("status", F.when(F.size("reasons") == 0, "GOOD").when(F.size("reasons") == 1, "PROVISIONAL").otherwise("FAILED"))


def frames_of_tiers(lidar: DataFrame, video: DataFrame, video_poses: DataFrame, photo: DataFrame) -> DataFrame:
    """Frames of all tiers with their pose, null where there is none. SfM quaternions are wxyz and become xyzw here."""
    poses = video_poses.select("image_name", "x", "y", "z", F.array(*[F.element_at("q", i) for i in (2, 3, 4, 1)]).alias("q"))
    parts = [lidar.withColumn("tier", F.lit("lidar")), video.join(poses, "image_name", "left").withColumn("tier", F.lit("video")), photo.withColumn("tier", F.lit("photo"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def posed_images(images: DataFrame, poses: DataFrame) -> DataFrame:
    """images (image_name) with the pose of their name; a missing one stays null."""
    return images.join(poses, "image_name", "left")


def metric_poses(poses: DataFrame) -> DataFrame:
    """Poses of a solver (r, t) whose translation has three finite numbers, as x, y, z; others get the reason."""
    sound = (F.size("t") == 3) & ~F.exists("t", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = F.coalesce(sound, F.lit(False))
    return poses.withColumns({**{c: F.when(sound, F.get("t", F.lit(i))) for i, c in enumerate("xyz")}, "reason": F.when(~sound, "no_translation")})


def first_frames(frames: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first most frames of each capture."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("frame"))
    return frames.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_rank")


def plane_documents(documents: DataFrame) -> DataFrame:
    """Planes of captures (capture_id, priority, detected_planes, planes, walls): the first list that is there in the first document."""
    found = documents.withColumn("_p", F.coalesce("detected_planes", "planes", "walls"))
    best = found.filter("_p is not null").groupBy("capture_id").agg(F.min_by("_p", "priority").alias("planes"))
    out = documents.select("capture_id").distinct().join(best, "capture_id", "left")
    return out.withColumn("status", F.when(F.col("planes").isNull(), "NOT_EVALUABLE").otherwise("OK"))




def image_measures(frames: DataFrame, key: str, order: str = "frame") -> DataFrame:
    """frames (key, order, width, height, pixels: grey values by rows) with sharpness, texture, mean, exposed and motion, without pixels.

    motion is the difference to the frame before in the same key, 0 for the first. Only thumbnails are compared, so the window moves
    those, or images that are smaller than a thumbnail. A null or
    empty image, or one whose number of pixels is not width times height, measures 0 and is not exposed.
    """
    thumbnail = pictures.THUMBNAIL[0] * pictures.THUMBNAIL[1]

    def images(width: pd.Series, height: pd.Series, pixels: pd.Series):
        for w, h, p in zip(width, height, pixels):
            sound = p is not None and w is not None and h is not None and w == w and h == h and len(p) == w * h
            yield np.asarray(p, np.uint8).reshape(int(h), int(w)) if sound else np.zeros((0, 0), np.uint8)

    def measured(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        out = []
        for image in images(width, height, pixels):
            small = image if image.size <= thumbnail else pictures.shrunk(image, *pictures.THUMBNAIL).astype(np.uint8)
            out.append((pictures.sharpness(image), pictures.texture(image), float(image.mean()) if image.size else 0.0, small.tobytes() if image.size else None, small.shape[1]))
        return pd.DataFrame(out, columns=["sharpness", "texture", "mean", "small", "across"])

    def moved(one: pd.Series, one_across: pd.Series, two: pd.Series, two_across: pd.Series) -> pd.Series:
        out = []
        for a, wa, b, wb in zip(one, one_across, two, two_across):
            pair = [pictures.shrunk(np.frombuffer(x, np.uint8).reshape(-1, int(w)), *pictures.THUMBNAIL) for x, w in ((a, wa), (b, wb))] if a is not None and b is not None else None
            out.append(float(np.abs(pair[0] - pair[1]).sum()) / thumbnail if pair else 0.0)
        return pd.Series(out, dtype=float)

    told = frames.withColumn("_m", F.pandas_udf(measured, "struct<sharpness:double,texture:double,mean:double,small:binary,across:int>")("width", "height", "pixels")).drop("pixels")
    told = told.withColumns({"sharpness": F.col("_m.sharpness"), "texture": F.col("_m.texture"), "mean": F.col("_m.mean"), "_small": F.col("_m.small"), "_across": F.col("_m.across")}).drop("_m")
    beside = Window.partitionBy(key).orderBy(order)
    before = told.withColumns({"_before": F.lag("_small").over(beside), "_before_across": F.lag("_across").over(beside)})
    return before.withColumns({"exposed": F.col("_small").isNotNull() & exposed(F.col("mean")), "motion": F.pandas_udf(moved, "double")("_before", "_before_across", "_small", "_across")}).drop("_small", "_across", "_before", "_before_across")
