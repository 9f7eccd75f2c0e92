"""Whole runs over captures: the operators in the order in which a user needs them.

Each takes and returns DataFrames of many captures at once. Only what is cut at a shuffle is computed twice; callers that use
several results of a run write them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.functions import plan, uncertainty
from planimetra.operators import evaluate, graph, imaging, measure, openings, points, rooms, structure, trajectory
from planimetra.operators.shared import cut


def reconstruction(pixels: DataFrame, poses: DataFrame, key: str = "capture_id", stride: int = 1, voxel: float = 0.03, confidence: int = 2, outliers: bool = True, neighbours: int = 20) -> dict[str, DataFrame]:
    """Depth pixels (key, frame, u, v, depth_mm, confidence, fx, fy, cx, cy) and poses (key, frame, ts_s, x.., qx..) to a cloud.

    cloud: one point a voxel, without outliers; funnel: pixels counted stage by stage; trajectory: path statistics; bounds of the cloud.
    """
    kept = pixels.filter((F.col("u") % stride == 0) & (F.col("v") % stride == 0))
    camera = points.unproject(points.confident(kept, confidence))
    named = poses.select(key, "frame", *[F.col(f"q{c}") for c in "xyzw"], *[F.col(c).alias(f"t{c}") for c in "xyz"])
    world = points.to_world(camera, named, [key, "frame"])
    cells = cut(points.voxels(world, voxel, [key]).withColumn("point_id", F.xxhash64(key, "vx", "vy", "vz")))
    cloud = points.without_outliers(cells, "point_id", neighbours, radius=4 * voxel, keys=[key]) if outliers else cells
    funnel = points.funnel(kept.withColumn("depth", F.col("depth_mm") / 1000.0), confidence, keys=[key])
    return {"cloud": cloud, "funnel": funnel, "trajectory": trajectory.statistics(poses, key), "bounds": points.bounds(cloud, [key])}


def structure_of(cloud: DataFrame, key: str = "capture_id", radius: float = 0.10, distance: float = 0.03, least_level: int = 3000, least_wall: int = 4000, tries: int = 200) -> dict[str, DataFrame]:
    """Floor, ceiling and walls of clouds (key, point_id, x, y, z).

    Points are split by their normals; planes are fitted to level and to upright ones, walls gated, merged and given their extent.
    """
    normals = imaging.normals(cloud, "point_id", radius, keys=[key])
    turned = cut(cloud.join(normals.select("point_id", "ny"), "point_id").withColumn("inclination", structure.inclination(F.col("ny"))))
    level, upright = (turned.filter(F.col("inclination") == kind) for kind in ("horizontal", "vertical"))
    flat = cut(structure.planes_by_ransac(level, key, least=least_level, distance=distance, tries=tries))
    levels = _with_points(level, flat, key, distance).groupBy(key, "plane_id").agg(F.avg("y").alias("y"), F.first("ny").alias("ny"), F.first("inliers").alias("inliers"))
    heights = cut(structure.floor_and_ceiling(levels, key, least_level))
    found = cut(structure.planes_by_ransac(upright, key, least=least_wall, distance=distance, tries=tries))
    along = F.col("z") * F.col("a") - F.col("x") * F.col("c")
    extent = _with_points(upright, found, key, distance).groupBy(key, "plane_id").agg(
        (F.max("y") - F.min("y")).alias("height"), F.min("y").alias("low"), *[f(along).alias(n) for f, n in ((F.min, "start"), (F.max, "end"))], *[F.avg(c).alias(f"{c}_mean") for c in "xz"]
    )
    walls = found.join(extent, [key, "plane_id"]).join(heights.select(key, "floor_y"), key).withColumns({"span": F.col("end") - F.col("start"), "floor_gap": F.coalesce(F.col("low") - F.col("floor_y"), F.lit(0.0))})
    gated = structure.wall_candidates(walls).withColumn("wall_id", F.col("plane_id"))
    merged = structure.merged_walls(gated.filter("reason is null"), key).filter("merged_into = wall_id").drop("merged_into", "reason")
    return {"levels": heights, "walls": merged.withColumn("confidence", uncertainty.plane_confidence(F.col("inliers"), F.col("rmse"))), "rejected": gated.filter("reason is not null")}


def _with_points(cloud: DataFrame, planes: DataFrame, key: str, distance: float) -> DataFrame:
    """cloud joined to the planes of its capture that it lies on."""
    d = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    return cloud.drop("ny").join(planes.withColumn("ny", F.col("b")), key).filter(d <= distance)


def footprint(walls: DataFrame, key: str = "capture_id", longest: float = 0.35, farthest: float = 0.40) -> DataFrame:
    """The room polygon of each capture from its walls (wall_id, a..d, start, end, rmse, confidence, height, inliers), with measures and errors.

    Walls that pass the quality gate meet in corners; consecutive corners of a wall are edges; of all simple cycles the best scored one is the room.
    A capture without one keeps a row with a null polygon.
    """
    good = structure.in_plan(structure.wall_quality(walls).filter("status = 'accepted'"))
    lined = good.filter("line is not null").select(key, "wall_id", F.col("line.a").alias("a"), F.col("line.b").alias("b"), F.col("line.c").alias("c"), "start", "end", "inliers")
    merged = imaging.merged_lines(lined, key)
    a, b, c = (F.col(x) for x in "abc")
    segments = merged.select(
        key, "wall_id", F.col("wall_id").alias("ord"), "inliers", F.struct("a", "b", "c").alias("line"), *[e for n, s in (("1", F.col("start")), ("2", F.col("end"))) for e in ((-c * a - b * s).alias(f"x{n}"), (-c * b + a * s).alias(f"z{n}"))]
    )
    corners = cut(structure.corners(segments, [key], longest, farthest).filter("accepted"))
    sides = corners.select(key, "corner", "x", "z", F.col("wall_a").alias("wall_id")).unionByName(corners.select(key, "corner", "x", "z", F.col("wall_b").alias("wall_id")))
    placed = sides.join(segments.select(key, "wall_id", "line"), [key, "wall_id"]).withColumn("s", F.col("z") * F.col("line.a") - F.col("x") * F.col("line.b"))
    edges = structure.connections(corners, [key], placed)
    cycles = graph.cycles(edges.select(key, F.col("source").cast("int").alias("source"), F.col("target").cast("int").alias("target"), "wall_id"), key)
    numbered = cycles.withColumn("ord", F.xxhash64(F.array_join("cycle", "-")))
    spread = numbered.select(key, "ord", F.posexplode("cycle").alias("place", "corner")).join(corners.select(key, "corner", "x", "z", "extension", "wall_a", "wall_b"), [key, "corner"])
    shaped = spread.groupBy(key, "ord").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "z"))), lambda v: F.struct(v["x"].alias("x"), v["z"].alias("z"))).alias("vertices"), F.avg("extension").alias("mean_extension"),
    )
    support = spread.select(key, "ord", F.explode(F.array("wall_a", "wall_b")).alias("wall_id")).distinct().join(segments.select(key, "wall_id", "inliers"), [key, "wall_id"]).groupBy(key, "ord").agg(F.sum("inliers").alias("inliers"))
    scored = measure.shape(shaped.join(support, [key, "ord"])).withColumns({"simple": F.col("crossings") == 0, "has_reference": F.lit(False), "cycle": F.col("vertices")})
    best = graph.best_cycle(scored, key).select(key, F.col("cycle").alias("vertices"))
    return measure.validated_polygon(measure.shape(walls.select(key).distinct().join(best, key, "left")))


def openings_of(observations: DataFrame, walls: DataFrame, key: str = "capture_id") -> DataFrame:
    """Openings of captures from their observations (key, observation_id, x, z, width, score, label, cos, sharpness, distance, left_clipped, right_clipped, depth_step and box x1..y2 in an image of image_width and image_height).

    Sane ones go to the wall that they fit best, near ones of a wall and class become one opening, which the better observations measure.
    """
    names = {"width": "_metres", "image_width": "width", "image_height": "height"}
    sane = openings.sane(observations.withColumnsRenamed(names)).filter("reason is null").withColumnsRenamed({b: a for a, b in reversed(names.items())}).withColumn("opening_id", F.col("observation_id"))
    hosted = openings.to_walls(sane, walls, [key]).select(key, "opening_id", "wall_id", F.col("distance").alias("wall_distance"))
    joined = sane.drop("reason").join(hosted, [key, "opening_id"]).withColumn("ord", F.col("observation_id"))
    clustered = cut(openings.clusters(joined, [key, "wall_id", "label"]))
    keys = [key, "wall_id", "label", "cluster"]
    return openings.fused(openings.audited(openings.with_spread(clustered, keys)), keys, "observation_id")


def property_of(rooms_: DataFrame, doors: DataFrame, key: str = "property_id", tier: str = "lidar") -> dict[str, DataFrame]:
    """Rooms (key, room_id, ord, vertices) of properties: their document, overlaps, neighbours and whether the plan is sound."""
    shaped = measure.validated_polygon(measure.shape(rooms_))
    overlaps = rooms.overlaps(rooms_, [key])
    document = rooms.property_document(shaped, [key], tier)
    faults = shaped.groupBy(key).agg(F.count_if(~F.col("valid")).alias("invalid_rooms")).join(overlaps.groupBy(key).agg(F.count(F.lit(1)).alias("overlaps")), key, "left").na.fill(0, ["overlaps"])
    sound = (F.col("invalid_rooms") == 0) & (F.col("overlaps") == 0)
    return {"document": document.join(faults, key).withColumn("valid", sound), "overlaps": overlaps, "adjacency": rooms.adjacency(rooms_, doors, [key])}


def benchmark(measurements: DataFrame, incumbent: DataFrame | None = None) -> DataFrame:
    """One report (section, name, numerator, denominator, value, result) of measurements (tier, room_id, entity, type, predicted, reference, lower, upper).

    Sections: gates, accuracy by tier and type, interval coverage by tier and, with its values (room_id, entity, type, incumbent), the comparison with another product.
    """
    empty = F.lit(None)
    gates = evaluate.gates(measurements).select(F.lit("gate").alias("section"), F.col("gate").alias("name"), F.col("numerator").cast("long").alias("numerator"), F.col("denominator").cast("long").alias("denominator"), F.col("threshold").alias("value"), "result")
    rows = evaluate.with_errors(measurements)
    n = F.count("absolute_error")
    accuracy = rows.groupBy("tier", "type").agg(n.alias("n"), F.count(F.lit(1)).alias("all"), F.avg("absolute_error").alias("mean"))
    accuracy = accuracy.select(F.lit("accuracy").alias("section"), F.concat_ws(".", "tier", "type").alias("name"), F.col("n").alias("numerator"), F.col("all").alias("denominator"), F.round("mean", 6).alias("value"), F.when(F.col("n") > 0, "EVALUATED").otherwise("NOT_EVALUABLE").alias("result"))
    held = F.col("reference").between(F.col("lower"), F.col("upper"))
    known = F.col("reference").isNotNull() & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    intervals = measurements.groupBy("tier").agg(F.count_if(known & held).alias("held"), F.count_if(known).alias("n"))
    intervals = intervals.select(F.lit("intervals").alias("section"), F.col("tier").alias("name"), F.col("held").alias("numerator"), F.col("n").alias("denominator"), F.round(F.col("held") / F.nullif(F.col("n"), F.lit(0)), 6).alias("value"), F.when(F.col("n") > 0, "EVALUATED").otherwise("NOT_EVALUABLE").alias("result"))
    report = gates.unionByName(accuracy).unionByName(intervals)
    if incumbent is not None:
        both = rows.filter("absolute_error is not null").select("tier", "room_id", "entity", "type", "reference", "absolute_error").join(incumbent, ["room_id", "entity", "type"]).withColumn("other", F.abs(F.col("incumbent") - F.col("reference")))
        wins = both.groupBy("tier").agg(F.count_if(F.col("absolute_error") < F.col("other")).alias("wins"), F.count("other").alias("n"))
        report = report.unionByName(wins.select(F.lit("incumbent").alias("section"), F.col("tier").alias("name"), F.col("wins").alias("numerator"), F.col("n").alias("denominator"), F.round(F.col("wins") / F.nullif(F.col("n"), F.lit(0)), 6).alias("value"), F.when(F.col("n") > 0, "EVALUATED").otherwise("NOT_EVALUABLE").alias("result")))
    return report
