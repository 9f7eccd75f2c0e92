"""Point clouds: filters, un-projection, voxels, residuals, support and outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimetra.functions.vectors import rotation, transformed
from planimetra.operators import spatial

AXES = ["x", "y", "z"]


def confident(points: DataFrame, least: int = 2) -> DataFrame:
    return points.filter(F.col("confidence") >= least)


def in_range(points: DataFrame, low: float, high: float) -> DataFrame:
    reach = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return points.filter(reach.between(low, high))


def voxels(points: DataFrame, size: float, keys: list[str] = (), colours: bool = False) -> DataFrame:
    """One row a voxel of a grid through the origin: vx, vy, vz, n_points, mean x, y, z and, truncated, r, g, b."""
    grid = [F.floor(F.col(c) / size).cast("long").alias(f"v{c}") for c in AXES]
    means = [F.avg(c).alias(c) for c in AXES] + [F.avg(c).cast("int").alias(c) for c in (("r", "g", "b") if colours else ())]
    return points.groupBy(*keys, *grid).agg(F.count(F.lit(1)).alias("n_points"), *means)


def with_views(cells: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """Adds the number of distinct views of each voxel."""
    grid = [F.floor(F.col(c) / size).cast("long").alias(f"v{c}") for c in AXES]
    return cells.join(points.groupBy(*grid).agg(F.count_distinct("view_id").alias("n_views")), ["vx", "vy", "vz"])


def funnel(pixels: DataFrame, least_confidence: int = 2, low: float = 0.2, high: float = 5.0, keys: list[str] = ()) -> DataFrame:
    """Counters of a capture: pixels, those confident, those also in range. pixels: confidence, depth."""
    sure = F.col("confidence") >= least_confidence
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.count_if(sure).alias("confident"),
        F.count_if(sure & F.col("depth").between(low, high)).alias("in_range"),
    )


def unproject(pixels: DataFrame, stride: int = 1, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """Camera points of pixels (u, v, depth_mm, fx, fy, cx, cy): x, y, z in metres; the stride is taken first."""
    z = F.col("depth_mm") / 1000.0
    kept = pixels if stride == 1 else pixels.filter((F.col("u") % stride == 0) & (F.col("v") % stride == 0))
    return kept.filter(z.between(low, high)).withColumns({"x": (F.col("u") - F.col("cx")) * z / F.col("fx"), "y": (F.col("v") - F.col("cy")) * z / F.col("fy"), "z": z})


def to_world(points: DataFrame, poses: DataFrame, key: str | list[str] = "frame") -> DataFrame:
    """Camera points joined to the pose of their frame (qx..qw, tx, ty, tz), in world coordinates."""
    joined = points.join(poses, key)
    world = transformed(rotation(tuple(F.col(f"q{c}") for c in "xyzw")), tuple(F.col(f"t{c}") for c in "xyz"), tuple(F.col(c) for c in "xyz"))
    return joined.withColumns(dict(zip(AXES, world, strict=True)))


def plane_residuals(points: DataFrame, plane: tuple[Column, Column, Column, Column], keys: list[str] = ()) -> DataFrame:
    """mean_abs and rmse of the distances to a plane; 0 for no points."""
    d = plane[0] * F.col("x") + plane[1] * F.col("y") + plane[2] * F.col("z") + plane[3]
    return points.withColumn("_d", d).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"), F.coalesce(F.avg(F.abs("_d")), F.lit(0.0)).alias("mean_abs"), F.coalesce(F.sqrt(F.avg(F.col("_d") * F.col("_d"))), F.lit(0.0)).alias("rmse")
    )


def bounds(points: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Per axis: least, largest, span and mean."""
    out = []
    for c in AXES:
        out += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), (F.max(c) - F.min(c)).alias(f"{c}_span"), F.avg(c).alias(f"{c}_mean")]
    return points.groupBy(*keys).agg(*out)


def supported(points: DataFrame, size: float = 0.05, least_views: int = 2, least_points: int = 100) -> DataFrame:
    """Points in voxels that least_views views see, with status OK; all points, PROVISIONAL, if fewer than least_points are left."""
    cells = points.withColumns({f"_v{c}": F.floor(F.col(c) / size) for c in AXES})
    keys = [f"_v{c}" for c in AXES]
    seen = cells.groupBy(*keys).agg(F.count_distinct("view_id").alias("_views"))
    marked = cells.join(seen, keys).withColumn("_ok", F.col("_views") >= least_views)
    total = marked.agg(F.count_if("_ok").alias("_n"))
    enough = F.col("_n") >= least_points
    return marked.crossJoin(F.broadcast(total)).filter(F.col("_ok") | ~enough).withColumn("status", F.when(enough, "OK").otherwise("PROVISIONAL")).select(*points.columns, "status")


def without_outliers(points: DataFrame, key: str, neighbours: int = 20, deviations: float = 2.0, radius: float = 1.0, keys: list[str] = ()) -> DataFrame:
    """Points whose mean distance to their nearest neighbours, of their capture (keys), is at most mean + deviations * std of all there.

    Neighbours are looked for within radius first, and farther for points that have too few there.
    """
    mean = spatial.nearest_of_all(points, AXES, radius, neighbours, key, keys).groupBy(key).agg(F.avg("distance").alias("_near"))
    near = points.join(mean, key)
    limit = near.groupBy(*keys).agg((F.avg("_near") + deviations * F.stddev_pop("_near")).alias("_limit"))
    return (near.join(limit, list(keys)) if keys else near.crossJoin(F.broadcast(limit))).filter(F.col("_near") <= F.col("_limit")).drop("_near", "_limit")


def near_planes(points: DataFrame, walls: DataFrame, keys: list[str], thickness: float = 0.06, margin: float = 0.15, cell: float = 0.5) -> DataFrame:
    """Points joined to walls (keys.., wall_id, a, b, c, d, x_min..z_max) of their capture in whose slab they lie.

    A wall is copied to the cells of its box that its slab can reach, so a point meets the walls of its own cell only.
    Ends of a box that are null or over 1 km away are taken from the capture's points.
    """
    d = lambda x, y, z: F.col("a") * x + F.col("b") * y + F.col("c") * z + F.col("d")
    ends = points.groupBy(*keys).agg(*[f(c).alias(f"_{c}_{n}") for c in AXES for f, n in ((F.min, "min"), (F.max, "max"))])
    far = 1000.0
    boxed = walls.join(ends, keys).withColumns({f"_{c}_{n}": F.when(F.abs(f"{c}_{n}") <= far, F.col(f"{c}_{n}") + (margin if n == "max" else -margin)).otherwise(F.col(f"_{c}_{n}")) for c in AXES for n in ("min", "max")})
    for c in AXES:
        steps = F.sequence(F.floor(F.col(f"_{c}_min") / cell), F.floor(F.col(f"_{c}_max") / cell))
        boxed = boxed.filter(F.col(f"_{c}_min") <= F.col(f"_{c}_max")).withColumn(f"_cell{AXES.index(c)}", F.explode(steps))
    middle = d(*[(F.col(f"_cell{i}") + 0.5) * cell for i in range(3)])
    reach = thickness + cell / 2 * (F.abs("a") + F.abs("b") + F.abs("c"))
    boxed = boxed.filter(F.abs(middle) <= reach).drop(*[f"_{c}_{n}" for c in AXES for n in ("min", "max")])
    placed = points.select("*", *spatial.cell(AXES, cell)).alias("p")
    cells = [f"_cell{i}" for i in range(3)]
    w = boxed.alias("w")
    distance = F.abs(F.col("w.a") * F.col("p.x") + F.col("w.b") * F.col("p.y") + F.col("w.c") * F.col("p.z") + F.col("w.d"))
    inside = distance < thickness
    for c in AXES:
        inside = inside & (F.col(f"p.{c}") >= F.col(f"w.{c}_min") - margin) & (F.col(f"p.{c}") <= F.col(f"w.{c}_max") + margin)
    joined = placed.join(w, [F.col(f"p.{k}") == F.col(f"w.{k}") for k in [*keys, *cells]]).filter(inside)
    return joined.select(*[F.col(f"p.{c}") for c in points.columns], "w.wall_id", distance.alias("plane_distance"))
