"""Geometry in the floor plan: lines A x + B z + C = 0, segments, rays, polygons as arrays of structs (x, z)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from planimetra.functions.vectors import Vector, degrees_between, dot, transformed, unit

#: Lines closer to parallel than this have no intersection.
PARALLEL_DEGREES = 10.0


def plane_line(a: Column, c: Column, d: Column) -> Column:
    """Line of a wall plane in the plan: struct (a, b, c), with a unit normal; null for level planes."""
    length = F.hypot(a, c)
    return F.when(length >= 1e-6, F.struct((a / length).alias("a"), (c / length).alias("b"), (d / length).alias("c")))


def line_intersection(one: Column, two: Column) -> Column:
    """struct (x, z), or null if the lines are within PARALLEL_DEGREES."""
    det = one["a"] * two["b"] - two["a"] * one["b"]
    x = (one["b"] * two["c"] - two["b"] * one["c"]) / det
    z = (two["a"] * one["c"] - one["a"] * two["c"]) / det
    return F.when(F.abs(det) >= math.sin(math.radians(PARALLEL_DEGREES)), F.struct(x.alias("x"), z.alias("z")))


def line_degrees(one: Column, two: Column) -> Column:
    """0 to 90."""
    return degrees_between(F.abs(one["a"] * two["a"] + one["b"] * two["b"]))


def beyond(s: Column, low: Column, high: Column) -> Column:
    """How far s lies outside [low, high]."""
    return F.greatest(low - s, s - high, F.lit(0.0))


def segment_distance(px, pz, ax, az, bx, bz, degenerate: float = 1e-10) -> Column:
    """Distance of a point to a segment; to its start where the squared length is below degenerate."""
    dx, dz = bx - ax, bz - az
    square = dx * dx + dz * dz
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (pz - az) * dz) / F.nullif(square, F.lit(0.0))))
    t = F.when(square < degenerate, 0.0).otherwise(t)
    return F.hypot(px - (ax + t * dx), pz - (az + t * dz))


def folded_degrees(one: Column, two: Column, symmetric: bool = True) -> Column:
    """Difference of two directions, folded at 180 and, for undirected ones, at 90."""
    turn = F.pmod(F.abs(one - two), F.lit(360.0))
    half = F.least(turn, 360.0 - turn)
    return F.least(half, 180.0 - half) if symmetric else half


def ray_hit(origin: Vector, direction: Vector, plane: tuple[Column, Column, Column, Column], nearest: float = 0.10, farthest: float = 8.0, grazing: float = 1e-4) -> Column:
    """struct (x, y, z, t) where a ray of any length meets a plane; null if nearly parallel, behind, too near or too far."""
    r = unit(direction)
    along = dot(plane[:3], r)
    t = -(dot(plane[:3], origin) + plane[3]) / F.nullif(along, F.lit(0.0))
    point = [(o + t * x).alias(n) for o, x, n in zip(origin, r, "xyz", strict=True)]
    return F.when((F.abs(along) >= grazing) & (t > nearest) & (t <= farthest), F.struct(*point, t.alias("t")))


def pixel_ray(u: Column, v: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Vector:
    return (u - cx) / fx, (v - cy) / fy, F.lit(1.0)


def pixel_hit(pixel: tuple[Column, Column], intrinsics: tuple, rotation: list[list[Column]], origin: Vector, plane: tuple) -> Column:
    zero = (F.lit(0.0),) * 3
    return ray_hit(origin, transformed(rotation, zero, pixel_ray(*pixel, *intrinsics)), plane)


def plan_width(one: Column, two: Column) -> Column:
    """Horizontal distance of two points with x and z."""
    return F.hypot(one["x"] - two["x"], one["z"] - two["z"])


def edges(vertices: Column) -> Column:
    """Array of structs (i, x1, z1, x2, z2), the last back to the start."""
    n = F.size(vertices)
    return F.transform(
        vertices,
        lambda v, i: F.struct(i.alias("i"), v["x"].alias("x1"), v["z"].alias("z1"), F.get(vertices, F.pmod(i + 1, n))["x"].alias("x2"), F.get(vertices, F.pmod(i + 1, n))["z"].alias("z2")),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def signed_area(vertices: Column) -> Column:
    return _sum(F.transform(edges(vertices), lambda e: e["x1"] * e["z2"] - e["x2"] * e["z1"])) / 2


def area(vertices: Column) -> Column:
    return F.abs(signed_area(vertices))


def perimeter(vertices: Column) -> Column:
    return _sum(F.transform(edges(vertices), lambda e: F.hypot(e["x2"] - e["x1"], e["z2"] - e["z1"])))


def centroid(vertices: Column) -> Column:
    """Area-weighted; the mean of the vertices where there are under three or no area."""
    n = F.size(vertices)
    twice = 2 * signed_area(vertices)
    weighted = lambda c: _sum(F.transform(edges(vertices), lambda e: (e[c + "1"] + e[c + "2"]) * (e["x1"] * e["z2"] - e["x2"] * e["z1"]))) / (3 * twice)
    mean = lambda c: _sum(F.transform(vertices, lambda v: v[c])) / n
    flat = (n < 3) | (F.abs(twice) < 2e-6)
    return F.when(n > 0, F.struct(*[F.when(flat, mean(c)).otherwise(weighted(c)).alias(c) for c in "xz"]))


def rotated(vertices: Column, radians: Column) -> Column:
    cos, sin = F.cos(radians), F.sin(radians)
    return F.transform(vertices, lambda v: F.struct((v["x"] * cos - v["z"] * sin).alias("x"), (v["x"] * sin + v["z"] * cos).alias("z")))


def crossings(vertices: Column) -> Column:
    """Number of pairs of edges without a common corner that cross or touch."""
    every = edges(vertices)
    n = F.size(vertices)
    side = lambda e, x, z: (e["x2"] - e["x1"]) * (z - e["z1"]) - (e["z2"] - e["z1"]) * (x - e["x1"])
    apart = lambda a, b: (b["i"] > a["i"] + 1) & ~((a["i"] == 0) & (b["i"] == n - 1))
    spans = lambda a, b, c: (F.greatest(F.least(a[c + "1"], a[c + "2"]), F.least(b[c + "1"], b[c + "2"])) <= F.least(F.greatest(a[c + "1"], a[c + "2"]), F.greatest(b[c + "1"], b[c + "2"])))
    meets = lambda a, b: (side(a, b["x1"], b["z1"]) * side(a, b["x2"], b["z2"]) <= 0) & (side(b, a["x1"], a["z1"]) * side(b, a["x2"], a["z2"]) <= 0) & spans(a, b, "x") & spans(a, b, "z")
    return _sum(F.transform(every, lambda a: F.size(F.filter(every, lambda b: apart(a, b) & meets(a, b))).cast("double"))).cast("int")


def canonical(vertices: Column, decimals: int = 4) -> Column:
    """The same array for polygons that are equal up to their start and direction, after rounding."""
    n = F.size(vertices)
    points = F.transform(vertices, lambda v: F.struct(F.round(v["x"], decimals).alias("x"), F.round(v["z"], decimals).alias("z")))
    turns = lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(p, k + 1, n - k), F.slice(p, 1, k)))
    return F.when(n > 0, F.array_min(F.concat(turns(points), turns(F.reverse(points))))).otherwise(points)


def rectangle(x0: Column, z0: Column, width: Column, depth: Column) -> Column:
    corner = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    return F.array(corner(x0, z0), corner(x0 + width, z0), corner(x0 + width, z0 + depth), corner(x0, z0 + depth))


def label_position(x1, y1, x2, y2, offset: float = 0.15) -> Column:
    """struct (x, y) beside the middle of a segment, to the left of its direction; the middle itself for a segment under 0.1 mm."""
    dx, dy = x2 - x1, y2 - y1
    length = F.hypot(dx, dy)
    side = F.when(length >= 1e-4, offset / length).otherwise(0.0)
    return F.struct(((x1 + x2) / 2 - dy * side).alias("x"), ((y1 + y2) / 2 + dx * side).alias("y"))


def label_angle(x1, y1, x2, y2) -> Column:
    """Degrees of a text along a segment, within -90 and 90, so that it never stands upside down."""
    angle = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return F.when(angle > 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)
