"""Several rooms: orientation, overlap, adjacency, assignment of walls and the property document."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.functions import plan, shapes


#: Half interval of an area by tier, relative, and its confidence.
TIER_AREA = {"lidar": (0.05, 0.95), "video": (0.10, 0.70), "photo": (0.15, 0.60)}


def dominant_orientation(walls: DataFrame, keys: list[str]) -> DataFrame:
    """Median direction of wall normals (a, c) modulo a right angle, from two walls on; else 0."""
    right = F.lit(np.pi / 2)
    angle = F.pmod(F.atan2("c", "a"), right)
    return walls.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 2, F.median(angle)).otherwise(0.0).alias("radians"), F.count(F.lit(1)).alias("walls"))


def box(vertices: Column) -> dict[str, Column]:
    axis = lambda c: F.transform(vertices, lambda v: v[c])
    return {"x_min": F.array_min(axis("x")), "x_max": F.array_max(axis("x")), "z_min": F.array_min(axis("z")), "z_max": F.array_max(axis("z"))}


def _pairs(rooms: DataFrame, keys: list[str], margin: float, cell: float = 10.0) -> DataFrame:
    """Pairs of rooms of a property whose boxes are at most margin apart, met in a grid rather than all with all."""
    table = rooms.select(*keys, "room_id", "vertices").withColumns(box(F.col("vertices")))
    span = lambda c, m: F.sequence(F.floor((F.col(f"{c}_min") - m) / cell), F.floor((F.col(f"{c}_max") + m) / cell))
    celled = table.withColumn("_x", F.explode(span("x", margin))).withColumn("_z", F.explode(span("z", margin)))
    a, b = celled.alias("a"), celled.alias("b")
    near = F.lit(True)
    for c in "xz":
        near = near & (F.col(f"a.{c}_min") - margin <= F.col(f"b.{c}_max")) & (F.col(f"b.{c}_min") - margin <= F.col(f"a.{c}_max"))
    # each pair is kept in the first cell that both have
    first = F.lit(True)
    for c in "xz":
        first = first & (F.col(f"a._{c}") == F.greatest(*[F.floor((F.col(f"{s}.{c}_min") - margin) / cell) for s in "ab"]))
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in [*keys, "_x", "_z"]] + [F.col("a.room_id") < F.col("b.room_id")])
    return joined.filter(near & first).select(*[F.col(f"a.{k}") for k in keys], F.col("a.room_id").alias("room_a"), F.col("b.room_id").alias("room_b"), F.col("a.vertices").alias("va"), F.col("b.vertices").alias("vb"))


def _pairwise(kernel) -> Column:
    """A function of two columns of polygons, in Arrow batches."""
    return F.pandas_udf(kernel, "double")("va", "vb")


def _array(vertices) -> np.ndarray:
    return np.array([(v["x"], v["z"]) for v in vertices], float)


def overlap_area(one: pd.Series, two: pd.Series) -> pd.Series:
    """Common area of two simple polygons."""
    return pd.Series([shapes.overlap(_array(a), _array(b)) for a, b in zip(one, two)])


#: Pairs of edges that are held at once.
_EDGES = 200_000


def _corners(polygons: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All corners, the first of each polygon and how many it has."""
    edge = polygons.offsets.to_numpy()
    flat = polygons.flatten()
    return np.column_stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "xz"]), edge[:-1] - edge[0], np.diff(edge)


def _neighbours(batches):
    """gap and contact of va and vb in place of them: pairs of as many corners go through NumPy together."""
    for batch in batches:
        (p, at, n), (q, of, m) = (_corners(batch.column(c)) for c in ("va", "vb"))
        gap, contact = np.full(len(n), np.inf), np.zeros(len(n))
        order = np.lexsort((m, n))
        new = np.flatnonzero(np.diff(n[order], prepend=-1) | np.diff(m[order], prepend=-1))
        for low, high in zip(new, np.append(new[1:], len(order))):
            a, b = int(n[order[low]]), int(m[order[low]])
            held = max(1, _EDGES // max(1, a * b))
            for k in range(low, high if a and b else low, held):
                some = order[k : min(high, k + held)]
                one, two = p[at[some, None] + np.arange(a)], q[of[some, None] + np.arange(b)]
                gap[some], contact[some] = shapes.polygon_gaps(one, two), shapes.contact_lengths(one, two)
        kept = [c for c in batch.schema.names if c not in ("va", "vb")]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(gap), pa.array(contact)], names=[*kept, "gap", "contact"])


def overlaps(rooms: DataFrame, keys: list[str], area: float = 0.10, ratio: float = 0.05) -> DataFrame:
    """Pairs of rooms of a property that share more than area, or than ratio of the smaller one."""
    pairs = _pairs(rooms, keys, 0.0).withColumn("overlap", _pairwise(overlap_area))
    table = pairs.withColumn("ratio", F.col("overlap") / F.nullif(F.least(plan.area(F.col("va")), plan.area(F.col("vb"))), F.lit(0.0)))
    return table.filter((F.col("overlap") > area) | (F.col("ratio") > ratio)).drop("va", "vb")


def _near_rooms(places: DataFrame, rooms: DataFrame, keys: list[str], reach: float, cell: float = 5.0) -> DataFrame:
    """places (keys.., x, z) with each room of theirs that they lie in (distance 0) or within reach of; rooms are met in a grid."""
    table = rooms.withColumns({f"_{n}": c for n, c in box(F.col("vertices")).items()})
    for c in "xz":
        table = table.withColumn(f"_g{c}", F.explode(F.sequence(F.floor((F.col(f"_{c}_min") - reach) / cell), F.floor((F.col(f"_{c}_max") + reach) / cell))))
    celled = places.withColumns({f"_g{c}": F.floor(F.col(c) / cell) for c in "xz"})
    joined = celled.join(table, [*keys, "_gx", "_gz"])
    x, z, edges = F.col("x"), F.col("z"), plan.edges(F.col("vertices"))
    turns = lambda e: ((e["z1"] > z) != (e["z2"] > z)) & (x < e["x1"] + (z - e["z1"]) / F.nullif(e["z2"] - e["z1"], F.lit(0.0)) * (e["x2"] - e["x1"]))
    inside = F.size(F.filter(edges, turns)) % 2 == 1
    gap = F.array_min(F.transform(edges, lambda e: plan.segment_distance(x, z, e["x1"], e["z1"], e["x2"], e["z2"])))
    near = joined.withColumn("distance", F.when(inside, 0.0).otherwise(gap)).filter(F.col("distance") <= reach)
    return near.drop("vertices", "_gx", "_gz", *[f"_{c}_{n}" for c in "xz" for n in ("min", "max")])


def door_links(openings: DataFrame, rooms: DataFrame, keys: list[str], reach: float = 0.5) -> DataFrame:
    """Rooms that an opening (opening_id, x, z) joins: the first two by ord within reach of it; one row a pair of rooms.

    rooms: keys.., room_id, ord, vertices. The exterior distance is 0 inside a room.
    """
    close = _near_rooms(openings, rooms.select(*keys, "room_id", "ord", "vertices"), keys, reach)
    two = close.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "opening_id").orderBy("ord"))).filter("_r <= 2")
    linked = two.groupBy(*keys, "opening_id").agg(F.sort_array(F.collect_list("room_id")).alias("r")).filter(F.size("r") == 2)
    return linked.select(*keys, F.col("r")[0].alias("room_a"), F.col("r")[1].alias("room_b"), "opening_id").groupBy(*keys, "room_a", "room_b").agg(F.min("opening_id").alias("opening_id"), F.lit(0.9).alias("shared_length"))


def contacts(rooms: DataFrame, doors: DataFrame, keys: list[str], reach: float = 0.35, least: float = 0.40) -> DataFrame:
    """Pairs without a door that touch or run side by side long enough; the shared length is nominal, 1 at least."""
    pairs = _pairs(rooms, keys, reach).join(doors.select(*keys, "room_a", "room_b"), [*keys, "room_a", "room_b"], "left_anti")
    named = [*keys, "room_a", "room_b"]
    table = pairs.select(*named, "va", "vb").mapInArrow(_neighbours, ", ".join([*[f"`{c}` {dict(pairs.dtypes)[c]}" for c in named], "gap double", "contact double"]))
    near = (F.col("gap") <= reach) & ((F.col("contact") >= least) | (F.col("gap") <= 0.05))
    return table.filter(near).select(*keys, "room_a", "room_b", F.greatest(F.lit(1.0), F.round("contact", 2)).alias("shared_length"), F.lit(True).alias("is_nominal"))


def adjacency(rooms: DataFrame, openings: DataFrame, keys: list[str]) -> DataFrame:
    doors = door_links(openings, rooms, keys).select(*keys, "room_a", "room_b", "shared_length", F.lit(True).alias("is_nominal"), F.lit("door").alias("kind"))
    return doors.unionByName(contacts(rooms, doors, keys).withColumn("kind", F.lit("contact")))


def walls_to_rooms(walls: DataFrame, rooms: DataFrame, keys: list[str], reach: float = 4.0) -> DataFrame:
    """Every room within reach of a wall's centre (x, z)."""
    near = _near_rooms(walls.select(*keys, "wall_id", "x", "z"), rooms.select(*keys, "room_id", "vertices"), keys, reach)
    return near.select(*keys, "wall_id", "room_id", "distance")


def visited_cells(poses: DataFrame, keys: list[str], size: float, share: float = 0.01, least: int = 10) -> DataFrame:
    """Grid cells of the plan with at least max(least, share of a trajectory's poses): the places that are rooms."""
    total = poses.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cells = poses.groupBy(*keys, F.floor(F.col("x") / size).alias("cx"), F.floor(F.col("z") / size).alias("cz")).agg(F.count(F.lit(1)).alias("poses"), F.avg("x").alias("x"), F.avg("z").alias("z"))
    return cells.join(total, keys).filter(F.col("poses") >= F.greatest(F.lit(least), F.floor(F.col("_n") * share))).drop("_n")


def room_of_cell(cells: DataFrame, size: float, reach: float = 2.0) -> DataFrame:
    """Cell polygons over 1 m2, else a square around the mean place."""
    own = plan.rectangle(F.col("cx") * size, F.col("cz") * size, F.lit(size), F.lit(size))
    square = plan.rectangle(F.col("x") - reach, F.col("z") - reach, F.lit(2 * reach), F.lit(2 * reach))
    return cells.withColumn("vertices", F.when(F.lit(size * size > 1.0), own).otherwise(square))


def _between(values: Column, low: Column, high: Column) -> Column:
    return F.filter(values, lambda x: (x >= low) & (x <= high))


def regions(poses: DataFrame, walls: DataFrame, keys: list[str], margin: float = 0.4) -> DataFrame:
    """Rooms and the connector of captures from where the camera was: keys.., room_id, is_connector, frames, area, parts (rectangles in x, z).

    poses: keys.., frame, x, z. walls: keys.., wall_id, x, z (middle), a, c (normal). In the frame of the walls' main direction, clustered
    wall lines cut the plan into cells; cells with enough poses are the connector (a middle band) or one of four quarters.
    A capture under 3.5 m wide is one room. A point of the plan is in one cell, so rooms never overlap.
    """
    k = [F.col(x) for x in keys]
    turn = dominant_orientation(walls, keys).select(*keys, "radians")
    placed = poses.join(turn, keys, "left").withColumn("radians", F.coalesce("radians", F.lit(0.0)))
    cos, sin = F.cos("radians"), F.sin("radians")
    uv = lambda x, z: (F.col(x) * cos + F.col(z) * sin, -F.col(x) * sin + F.col(z) * cos)
    placed = placed.withColumns(dict(zip("uv", uv("x", "z"))))
    ends = placed.groupBy(*keys).agg(F.first("radians").alias("radians"), F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{s}") for c in "xzuv" for f, s in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))])
    small = ((F.col("x_max") - F.col("x_min") + 1) < 3.5) & ((F.col("z_max") - F.col("z_min") + 1) < 3.5)
    whole = F.array(plan.rectangle(F.col("x_min") - 0.5, F.col("z_min") - 0.5, F.col("x_max") - F.col("x_min") + 1, F.col("z_max") - F.col("z_min") + 1))
    one = ends.filter(small).select(*keys, F.lit("room_01").alias("room_id"), F.lit(False).alias("is_connector"), F.col("n").alias("frames"), plan.area(whole[0]).alias("area"), whole.alias("parts"))

    turned = walls.join(ends.filter(~small).select(*keys, "radians"), keys)
    (nu, nv), (cu, cv) = uv("a", "c"), uv("x", "z")
    axis = F.when(F.abs(nu) > F.abs(nv), "u").otherwise("v")
    from planimetra.operators.structure import line_clusters

    lines = line_clusters(turned.select(*keys, axis.alias("axis"), F.when(axis == "u", cu).otherwise(cv).alias("position")), [*keys, "axis"])
    by_axis = lines.groupBy(*keys).agg(*[F.collect_list(F.when(F.col("axis") == a, F.col("position"))).alias(f"{a}_lines") for a in "uv"])
    large = ends.filter(~small).join(by_axis, keys, "left")
    for a in "uv":
        low, high = F.col(f"{a}_min") - margin, F.col(f"{a}_max") + margin
        inner = _between(F.coalesce(f"{a}_lines", F.array().cast("array<double>")), low, high)
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(low), inner, F.array(high))))
        large = large.withColumn(f"{a}_cuts", F.when(F.size(cuts) < 3, F.array(low, (F.col(f"{a}_min") + F.col(f"{a}_max")) / 2, high)).otherwise(cuts))
    at = lambda a: F.size(F.filter(f"{a}_cuts", lambda b: b <= F.col(a))) - 1
    celled = placed.select(*keys, "u", "v").join(large, keys).withColumns({"i": at("u"), "j": at("v")})
    cut = lambda a, i: F.get(f"{a}_cuts", i)
    counted = celled.groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("frames")).join(large, keys).filter(F.col("frames") >= F.greatest(F.lit(10), F.floor(F.col("n") / 100)))
    counted = counted.withColumns({"u0": cut("u", F.col("i")), "u1": cut("u", F.col("i") + 1), "v0": cut("v", F.col("j")), "v1": cut("v", F.col("j") + 1)}).withColumns({"cu": (F.col("u0") + F.col("u1")) / 2, "cv": (F.col("v0") + F.col("v1")) / 2})
    every = Window.partitionBy(*keys)
    low, high = (F.col("v_min") + (F.col("v_max") - F.col("v_min")) * s for s in (0.35, 0.65))
    counted = counted.withColumn("_band", F.col("cv").between(low, high) & (F.count(F.lit(1)).over(every) > 3))
    central = F.row_number().over(every.orderBy(F.hypot(F.col("cu") - F.col("u_mean"), F.col("cv") - F.col("v_mean")), "i", "j"))
    connector = F.col("_band") | (~F.max("_band").over(every) & (central == 1))
    west, north = F.col("cu") < (F.col("u_min") + F.col("u_max")) / 2, F.col("cv") >= high
    quarter = F.when(north, F.when(west, 1).otherwise(2)).otherwise(F.when(west, 4).otherwise(3))
    grouped = counted.withColumn("is_connector", connector).withColumn("_quarter", F.when(F.col("is_connector"), 5).otherwise(quarter))
    back = lambda u, v: F.struct((u * F.cos("radians") - v * F.sin("radians")).alias("x"), (u * F.sin("radians") + v * F.cos("radians")).alias("z"))
    part = F.array(*[back(F.col(a), F.col(b)) for a, b in (("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1"))])
    area = (F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))
    table = grouped.groupBy(*keys, "_quarter", "is_connector").agg(F.sum("frames").alias("frames"), F.sum(area).alias("area"), F.transform(F.sort_array(F.collect_list(F.struct("i", "j", part.alias("p")))), lambda c: c["p"]).alias("parts"))
    table = table.filter(F.col("is_connector") | (F.col("area") >= 1.0))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_quarter"))
    named = table.withColumn("room_id", F.when(F.col("is_connector"), "connector_01").otherwise(F.format_string("room_%02d", number)))
    return one.unionByName(named.select(*k, "room_id", "is_connector", "frames", "area", "parts"))


def moved_rooms(rooms: DataFrame, transforms: DataFrame, slack: float = 0.03) -> DataFrame:
    """Rooms (room_id, vertices) under their rigid transform (matrix of 16); those whose matrix is not rigid get a reason."""
    from planimetra.functions.vectors import cell, cross, dot

    m = F.col("matrix")
    rows = [tuple(cell(m, i, j) for j in range(3)) for i in range(3)]
    finite = ~F.exists(m, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ortho = F.lit(True)
    for i in range(3):
        ortho = ortho & (F.abs(F.sqrt(dot(rows[i], rows[i])) - 1) <= slack)
        for j in range(i):
            ortho = ortho & (F.abs(dot(rows[i], rows[j])) <= 2 * slack)
    rigid = F.coalesce((F.size(m) == 16) & finite & ortho & (dot(cross(rows[0], rows[1]), rows[2]) > 0), F.lit(False))
    moved = F.transform("vertices", lambda v: F.struct((cell(m, 0, 0) * v["x"] + cell(m, 0, 2) * v["z"] + cell(m, 0, 3)).alias("x"), (cell(m, 2, 0) * v["x"] + cell(m, 2, 2) * v["z"] + cell(m, 2, 3)).alias("z")))
    joined = rooms.join(transforms.select("room_id", "matrix"), "room_id", "left").withColumn("_ok", rigid)
    return joined.withColumns({"vertices": F.when(F.col("_ok"), moved), "reason": F.when(m.isNull(), "no_transform").when(~F.col("_ok"), "not_rigid")}).drop("matrix", "_ok")


def property_document(rooms: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """One row a property: its rooms as sorted structs with area intervals, and the total area."""
    share, confidence = TIER_AREA[tier]
    area = F.col("area")
    room = F.struct("room_id", F.round(area, 3).alias("area"), F.round(area * (1 - share), 3).alias("lower"), F.round(area * (1 + share), 3).alias("upper"), F.lit(confidence).alias("confidence"))
    return rooms.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rooms"), F.round(F.sum("area"), 3).alias("total_area"), F.sort_array(F.collect_list(room)).alias("rooms"))
