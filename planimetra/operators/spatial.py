"""Distance joins without a quadratic plan: a grid of the radius turns them into equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimetra.operators.shared import cut


def cell(columns: list[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long").alias(f"_cell{i}") for i, c in enumerate(columns)]


def distance(left: DataFrame, right: DataFrame, columns: list[str], a: str = "a", b: str = "b") -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + (F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) * (F.col(f"{a}.{c}") - F.col(f"{b}.{c}"))
    return F.sqrt(total)


def within(left: DataFrame, right: DataFrame, columns: list[str], radius: float, keys: list[str] = (), extra: Column | None = None) -> DataFrame:
    """Pairs with structs a and b, and their distance, at most radius apart and equal in keys.

    Cells are two radii wide: left is copied to those that its ball may touch, 2**d mostly, right stays in one, so each pair meets once. extra may name a.* and
    b.*. A cell shared by very many rows is split by the adaptive skew join. Rows with a null coordinate join nothing.
    """
    names, size, reach = [f"_cell{i}" for i in range(len(columns))], 2 * radius, radius * (1 + 1e-9)
    spread = left.select(F.struct(*left.columns).alias("a"), *[F.col(k).alias(f"_{k}") for k in keys], *[F.sequence(F.floor((F.col(c) - reach) / size), F.floor((F.col(c) + reach) / size)).alias(n) for n, c in zip(names, columns)])
    for n in names:
        spread = spread.withColumn(n, F.explode(n))
    still = right.select(F.struct(*right.columns).alias("b"), *[F.col(k).alias(f"_{k}") for k in keys], *cell(columns, size))
    joined = spread.join(still, [*[f"_{k}" for k in keys], *names]).withColumn("distance", distance(left, right, columns))
    kept = joined.filter(F.col("distance") <= radius)
    return (kept if extra is None else kept.filter(extra)).select("a", "b", "distance")


def nearest(left: DataFrame, right: DataFrame, columns: list[str], radius: float, k: int, key: str, keys: list[str] = ()) -> DataFrame:
    """For each row of left its k nearest others of right within radius and equal in keys: key, neighbour's key, distance, rank from 1."""
    from pyspark.sql.window import Window

    pairs = within(left, right, columns, radius, keys, extra=F.col(f"a.{key}") != F.col(f"b.{key}")).select(F.col(f"a.{key}").alias(key), F.col(f"b.{key}").alias("neighbour"), "distance")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "neighbour"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _crowded(points: DataFrame, columns: list[str], radius: float, k: int, keys: list[str]) -> float:
    """radius, or where a point has many more than k others within it, one that holds about 2 * k."""
    cells = points.groupBy(*keys, *cell(columns, radius)).agg(F.count(F.lit(1)).cast("double").alias("n"))
    crowd = 4 * (cells.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0)
    return radius if crowd <= 8 * k else radius * (2 * k / crowd) ** (1 / len(columns))


def _widened(points: DataFrame, columns: list[str], radius: float, reach: float, k: int, key: str, keys: list[str]) -> DataFrame:
    """nearest() of points among themselves within reach: from radius on, points with fewer than k neighbours look twice as far, again and again."""
    left, out = points, None
    while True:
        last = radius >= reach
        found = cut(nearest(left, points, columns, radius, k, key, keys))
        if last:
            return found if out is None else out.unionByName(found)
        done = found.filter(F.col("rank") == k).select(key)
        part = found.join(done, key, "left_semi")
        out = part if out is None else out.unionByName(part)
        left = cut(left.join(done, key, "left_anti"))
        if left.isEmpty():
            return out
        radius = min(2 * radius, reach)


def nearest_among(points: DataFrame, columns: list[str], radius: float, k: int, key: str, keys: list[str] = ()) -> DataFrame:
    """nearest() of points among themselves. Crowded points look nearby first, so that the pairs that meet grow with points and not with their density."""
    start = _crowded(points, columns, radius, k, keys)
    return nearest(points, points, columns, radius, k, key, keys) if start >= radius else _widened(points, columns, start, radius, k, key, keys)


def nearest_of_all(points: DataFrame, columns: list[str], radius: float, k: int, key: str, keys: list[str] = ()) -> DataFrame:
    """nearest() of points among themselves without a largest radius; the rounds end when the radius spans all points."""
    span = points.agg(*[(F.max(c) - F.min(c)).alias(c) for c in columns]).first()
    return _widened(points, columns, _crowded(points, columns, radius, k, keys), sum((x or 0.0) ** 2 for x in span) ** 0.5, k, key, keys)
