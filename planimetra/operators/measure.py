"""Room measurements with intervals and their validity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.functions import plan
from planimetra.functions.gates import reasons
from planimetra.functions.uncertainty import NORMAL_95, area_confidence, corner_sigma, length_interval, measurement, wall_confidence
from planimetra.functions.vectors import clipped
from planimetra.operators.shared import spread

#: Corners of samples that are held at once.
_DRAWN = 250_000
#: Rooms whose samples a task remembers for others of the same corners and noise, at most.
_REMEMBERED = 100_000


def shape(rooms: DataFrame, vertices: str = "vertices") -> DataFrame:
    """Adds area, perimeter, n_edges, shortest_edge and crossings of polygons."""
    v = F.col(vertices)
    lengths = F.transform(plan.edges(v), lambda e: F.hypot(e["x2"] - e["x1"], e["z2"] - e["z1"]))
    return rooms.withColumns({"area": plan.area(v), "perimeter": plan.perimeter(v), "n_edges": F.size(v), "shortest_edge": F.array_min(lengths), "crossings": plan.crossings(v)})


def validated_polygon(rooms: DataFrame) -> DataFrame:
    """Adds errors, warnings and valid to rooms with shape(): three corners, no duplicates, simple, 1 to 500 m2."""
    distinct = F.size(F.array_distinct(F.transform("vertices", lambda v: F.struct(F.round(v["x"], 4).alias("x"), F.round(v["z"], 4).alias("z")))))
    errors = reasons(too_few_vertices=F.coalesce(distinct < 3, F.lit(True)), duplicate_vertices=distinct < F.size("vertices"), self_intersecting=F.col("crossings") > 0, area_out_of_range=~F.col("area").between(1.0, 500.0))
    return rooms.withColumns({"errors": errors, "warnings": reasons(short_edge=F.col("shortest_edge") < 0.20)}).withColumn("valid", F.size("errors") == 0)


def validity(rooms: DataFrame) -> DataFrame:
    """Adds validity (VALID, PROVISIONAL, INVALID) and its reasons.

    rooms: n_vertices, polygon_errors (array), shortest_edge, inferred_corners, largest_extension, support, largest_rmse, multi_edge_walls.
    """
    fatal = (F.col("n_vertices") < 3) | F.exists("polygon_errors", lambda e: e.contains("invalid") | e.contains("self_intersecting") | e.contains("not_closed"))
    soft = reasons(
        short_edge=F.col("shortest_edge") < 0.35, inferred_corner=F.col("inferred_corners") > 0, long_extension=F.col("largest_extension") > 0.05, low_support=F.col("support") < 0.70,
        high_rmse=F.col("largest_rmse") > 0.05, walls_with_several_edges=F.col("multi_edge_walls") >= 2,
    )
    return rooms.withColumn("reasons", F.when(fatal, F.col("polygon_errors")).otherwise(soft)).withColumn("validity", F.when(fatal, "INVALID").when(F.size(soft) > 0, "PROVISIONAL").otherwise("VALID"))


def quality(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Support, mean fit, inferred share, extensions and a weighted score of polygons from their edges (length, supported, rmse, confidence, inferred, extension)."""
    table = edges.groupBy(*keys).agg(
        F.least(F.lit(1.0), F.sum("supported") / F.nullif(F.sum("length"), F.lit(0.0))).alias("support"), F.avg("rmse").alias("rmse"), F.avg("confidence").alias("confidence"),
        F.avg(F.col("inferred").cast("int")).alias("inferred_share"), F.avg("extension").alias("mean_extension"), F.max("extension").alias("largest_extension"),
    )
    score = 0.4 * F.col("support") + 0.3 * F.col("confidence") + 0.2 * (1 - F.col("inferred_share")) + 0.1 * F.greatest(F.lit(0.0), 1 - F.col("rmse") / 0.15)
    return table.withColumn("score", score)


def ceiling_height(rooms: DataFrame) -> DataFrame:
    """Height and interval from floor_y, ceiling_y, floor_rmse, ceiling_rmse; null where a level is not observed."""
    height = F.col("ceiling_y") - F.col("floor_y")
    half = NORMAL_95 * F.hypot("floor_rmse", "ceiling_rmse")
    return rooms.withColumns({"height": height, "lower": height - half, "upper": height + half})


def monte_carlo(rooms: DataFrame, key: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """95 % intervals and population std of area and perimeter under corner noise (vertices, sigma arrays), the same for equal seeds.

    A corner's sigma is shared by both axes (sigma / sqrt 2 each); a shorter list repeats its last. Areas are absolute shoelace areas of each sample, crossing or not.
    As equal seeds give equal draws, rooms of the same corners and sigmas have the same samples, and a task takes them once.
    """
    schema = f"`{key}` {dict(rooms.dtypes)[key]}, area_lower double, area_upper double, area_std double, perimeter_lower double, perimeter_upper double, perimeter_std double"
    lists = lambda column: (column.value_lengths().fill_null(0).to_numpy(False), column.flatten().cast("double").to_numpy(False))

    def sampled(x: np.ndarray, z: np.ndarray, sigma: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """Bounds and std of rooms (rows) of as many corners."""
        s = (np.maximum(sigma, 0) / np.sqrt(2))[:, None]
        qx, qz = x[:, None] + noise[None, :, :, 0] * s, z[:, None] + noise[None, :, :, 1] * s
        rx, rz = np.roll(qx, -1, axis=2), np.roll(qz, -1, axis=2)
        area = np.abs((qx * rz - rx * qz).sum(axis=2)) / 2
        length = np.hypot(rx - qx, rz - qz).sum(axis=2)
        return np.stack([f for v in (area, length) for f in (*np.percentile(v, [2.5, 97.5], axis=1), v.std(axis=1))], axis=1)

    def run(batches):
        noises: dict[int, np.ndarray] = {}
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            (corners, x), (_, z), (sigmas, sigma) = (lists(batch.column(i)) for i in (1, 2, 3))
            start, of_sigma = np.cumsum(corners) - corners, np.cumsum(sigmas) - sigmas
            out = np.zeros((len(corners), 6))
            for n in np.unique(corners):
                # rooms of as many corners share their draws, as each starts from the seed
                if n not in noises:
                    noises[n] = np.random.RandomState(seed).standard_normal((samples, n, 2))
                same, step = np.flatnonzero(corners == n), max(1, _DRAWN // max(1, samples * int(n)))
                place = start[same, None] + np.arange(n)
                own = of_sigma[same, None] + np.minimum(np.arange(n), np.maximum(sigmas[same, None] - 1, 0))
                given = np.ascontiguousarray(np.stack([x[place], z[place], sigma[own]], axis=1))
                keys = [r.tobytes() for r in given]
                if len(known) > _REMEMBERED:
                    known.clear()
                new = list({k: i for i, k in enumerate(keys) if k not in known}.values())
                for rows in (new[at : at + step] for at in range(0, len(new), step)):
                    known.update(zip((keys[i] for i in rows), sampled(*given[rows].swapaxes(0, 1), noises[n])))
                if len(same):
                    out[same] = [known[k] for k in keys]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.T)], names=[key, "area_lower", "area_upper", "area_std", "perimeter_lower", "perimeter_upper", "perimeter_std"])

    axis = lambda c: F.transform("vertices", lambda v: v[c].cast("double"))
    return spread(rooms.select(key, axis("x").alias("x"), axis("z").alias("z"), F.col("sigma").cast("array<double>").alias("sigma")), [key]).mapInArrow(run, schema)


#: What a corner's walls, an edge's wall and the levels are taken to be where nothing is known of them.
CORNER_RMSE, EDGE_RMSE, EDGE_CONFIDENCE, FLOOR_RMSE, CEILING_RMSE, LEVEL_CONFIDENCE = 0.02, 0.025, 0.70, 0.015, 0.025, 0.8


def _edges_of(rooms: DataFrame, corners: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One row an edge: its ends, their corners' sigmas, length with interval and confidence."""
    placed = rooms.select(key, F.posexplode("vertices").alias("i", "v")).select(key, "i", F.col("v.x").alias("x"), F.col("v.z").alias("z"))
    # tables as large as rooms' own: small files of them would be broadcast through the driver once exploded
    known = corners.select(key, "i", "corner_id", "inferred", "extension", "degrees", "rmse_a", "rmse_b").hint("merge")
    number = F.col("i") + 1
    placed = placed.join(known, [key, "i"], "left").withColumns({
        "corner_id": F.coalesce("corner_id", F.format_string("corner_%02d", number)), "inferred": F.coalesce("inferred", F.lit(False)), "extension": F.coalesce("extension", F.lit(0.0)),
        "sigma": corner_sigma(F.coalesce("rmse_a", F.lit(CORNER_RMSE)), F.coalesce("rmse_b", F.lit(CORNER_RMSE)), F.sin(F.radians(F.coalesce("degrees", F.lit(90.0)))), F.coalesce("inferred", F.lit(False)), F.coalesce("extension", F.lit(0.0))),
    })
    order = Window.partitionBy(key).orderBy("i")
    next_ = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order))
    ringed = placed.withColumns({f"{c}_2": next_(c) for c in ("x", "z", "sigma", "inferred", "extension", "corner_id")})
    joined = ringed.join(edges.select(key, "i", "wall_id", "rmse", "confidence").hint("merge"), [key, "i"], "left")
    length, rmse = F.hypot(F.col("x_2") - F.col("x"), F.col("z_2") - F.col("z")), F.coalesce("rmse", F.lit(EDGE_RMSE))
    lower, upper = length_interval(length, F.col("sigma"), F.col("sigma_2"), rmse)
    inferred = F.col("inferred").cast("int") + F.col("inferred_2").cast("int")
    return joined.withColumns({"wall_id": F.coalesce("wall_id", F.format_string("wall_%02d", number)), "length": length, "lower": lower, "upper": upper, "edge_confidence": wall_confidence(F.coalesce("confidence", F.lit(EDGE_CONFIDENCE)), rmse, inferred)})


def assembled(rooms: DataFrame, corners: DataFrame, edges: DataFrame, levels: DataFrame, key: str, samples: int = 1000, seed: int = 42) -> DataFrame:
    """The measurements of each room in one row: key, status, reasons, walls, perimeter, floor_area, ceiling_height, ceiling_status, wall_count, inferred_corners.

    rooms: key, vertices (not closed), validity, reasons, support (share of the boundary that was seen; null: all). corners: key, i (vertex from 0), corner_id, inferred, extension, degrees,
    rmse_a, rmse_b. edges: key, i (from vertex i to the next), wall_id, rmse, confidence. levels: key, floor_y, ceiling_y and their rmse and confidence. Whatever of these is missing is
    taken as the constants above say; a missing level leaves ceiling_height null and not_observed. A measurement is a struct of value, unit, lower, upper, interval, confidence, method, to the
    millimetre. Area and perimeter get their bounds from samples of the corners' noise, lengths and heights theirs in closed form.
    """
    sides = _edges_of(rooms, corners, edges, key)
    rounded = lambda c: F.round(c, 3)
    length = measurement(rounded(F.col("length")), "m", rounded(F.col("lower")), rounded(F.col("upper")), rounded(F.col("edge_confidence")), "polygon_edge")
    wall = F.struct("i", "wall_id", F.col("corner_id").alias("start_corner"), F.col("corner_id_2").alias("end_corner"), length.alias("length"), (F.col("inferred") | F.col("inferred_2")).alias("has_inferred_corner"))
    told = sides.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("i", "sigma"))).alias("_s"), F.sort_array(F.collect_list(wall)).alias("walls"), F.sum("length").alias("_perimeter"), F.avg("edge_confidence").alias("_mean"), F.count(F.lit(1)).alias("wall_count"),
        F.count_if("inferred").alias("inferred_corners"),
    )
    whole = rooms.select(key, "vertices", "validity", "reasons", F.coalesce("support", F.lit(1.0)).alias("_support")).join(told.hint("merge"), key, "left").withColumn("sigma", F.transform("_s", lambda s: s["sigma"]))
    noise = monte_carlo(whole.filter("wall_count >= 3"), key, samples, seed)
    high = levels.select(key, "floor_y", "ceiling_y", *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("floor_rmse", FLOOR_RMSE), ("ceiling_rmse", CEILING_RMSE), ("floor_confidence", LEVEL_CONFIDENCE), ("ceiling_confidence", LEVEL_CONFIDENCE))])
    table = whole.join(noise.hint("merge"), key, "left").join(high.hint("merge"), key, "left")
    share = F.col("inferred_corners") / F.greatest(F.col("wall_count"), F.lit(1))
    perimeter = measurement(rounded(F.col("_perimeter")), "m", rounded(F.col("perimeter_lower")), rounded(F.col("perimeter_upper")), rounded(clipped(F.col("_mean") * (1 - 0.15 * share), 0.10, 0.99)), "polygon_edge_sum")
    area = measurement(rounded(plan.area(F.col("vertices"))), "m2", rounded(F.col("area_lower")), rounded(F.col("area_upper")), rounded(area_confidence(F.col("_mean"), F.col("_support"), share, F.col("validity") == "PROVISIONAL")), "polygon_monte_carlo")
    height, half = F.abs(F.col("ceiling_y") - F.col("floor_y")), NORMAL_95 * F.hypot("floor_rmse", "ceiling_rmse")
    ceiling = measurement(rounded(height), "m", rounded(height - half), rounded(height + half), rounded(F.sqrt(F.col("floor_confidence") * F.col("ceiling_confidence"))), "level_planes_distance")
    shaped = F.col("wall_count") >= 3
    return table.select(
        key, F.col("validity").alias("status"), "reasons", "walls", F.when(shaped, perimeter).alias("perimeter"), F.when(shaped, area).alias("floor_area"), F.when(height.isNotNull(), ceiling).alias("ceiling_height"),
        F.when(height.isNotNull(), "observed").otherwise("not_observed").alias("ceiling_status"), F.coalesce("wall_count", F.lit(0)).alias("wall_count"), F.coalesce("inferred_corners", F.lit(0)).alias("inferred_corners"),
    )
