"""Vectors, quaternions (x, y, z, w) and rigid transforms (row-major arrays of 16) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(*names: str) -> Vector:
    return tuple(F.col(n) for n in names)  # type: ignore[return-value]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(x - y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vector) -> Vector:
    """Null components for a vector of no length."""
    n = F.nullif(norm(a), F.lit(0.0))
    return tuple(x / n for x in a)  # type: ignore[return-value]


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def degrees_between(cosine: Column) -> Column:
    return F.degrees(F.acos(clipped(cosine, -1.0, 1.0)))


def rotation(q: tuple[Column, Column, Column, Column]) -> list[list[Column]]:
    """3x3 rotation of a quaternion of any length; the identity for one of no length."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = (F.when(n > 0, c / n).otherwise(F.lit(d)) for c, d in zip(q, (0.0, 0.0, 0.0, 1.0), strict=True))
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]


def pose_matrix(q: tuple[Column, Column, Column, Column], t: Vector) -> Column:
    r = rotation(q)
    cells = [*r[0], t[0], *r[1], t[1], *r[2], t[2], *map(F.lit, (0.0, 0.0, 0.0, 1.0))]
    return F.array(*cells)


def transformed(r: list[list[Column]], t: Vector, p: Vector) -> Vector:
    """Camera point to world point."""
    return tuple(dot(tuple(row), p) + s for row, s in zip(r, t, strict=True))  # type: ignore[return-value, arg-type]


def cell(matrix: Column, row: int, column: int) -> Column:
    return matrix[4 * row + column]


def relative_transform(to: Column, of: Column) -> Column:
    """Inverse of the rigid matrix `to` times `of`."""
    rows = []
    for i in range(3):
        for j in range(4):
            terms = [cell(to, k, i) * (cell(of, k, j) - (cell(to, k, 3) if j == 3 else F.lit(0.0))) for k in range(3)]
            rows.append(terms[0] + terms[1] + terms[2])
    return F.array(*rows, *map(F.lit, (0.0, 0.0, 0.0, 1.0)))


def translation_length(matrix: Column) -> Column:
    return norm(tuple(cell(matrix, i, 3) for i in range(3)))  # type: ignore[arg-type]


def rotation_degrees(matrix: Column) -> Column:
    return degrees_between((cell(matrix, 0, 0) + cell(matrix, 1, 1) + cell(matrix, 2, 2) - 1) / 2)


def quaternion_degrees(a: tuple, b: tuple) -> Column:
    """Angle of the rotation between two unit quaternions."""
    cosine = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(cosine))))


def surface_basis(n: Vector) -> tuple[Vector, Vector]:
    """Two unit axes in the plane of unit normal n; across, then up. Nearly level planes use the z axis as seed."""
    level = F.abs(n[1]) > 0.85
    seed = (F.lit(0.0), F.when(level, 0.0).otherwise(1.0), F.when(level, 1.0).otherwise(0.0))
    across = unit(cross(seed, n))
    return across, cross(n, across)


def facing(plane: tuple[Column, ...], component: int, positive: bool = True) -> tuple[Column, ...]:
    """The plane (a, b, c, d), turned so that a component of its normal has the sign."""
    wrong = plane[component] < 0 if positive else plane[component] > 0
    return tuple(F.when(wrong, -x).otherwise(x) for x in plane)
