"""Measurements with intervals, confidences and errors. Missing evidence stays null; nothing is filled with zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planimetra.functions.vectors import clipped

NORMAL_95 = 1.96


def measurement(value: Column, unit: str, lower: Column, upper: Column, confidence: Column, method: str) -> Column:
    return F.struct(value.alias("value"), F.lit(unit).alias("unit"), lower.alias("lower"), upper.alias("upper"), F.array(lower, upper).alias("interval"), confidence.alias("confidence"), F.lit(method).alias("method"))


def known(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def absolute_error(predicted: Column, reference: Column) -> Column:
    return F.abs(known(predicted) - known(reference))


def relative_error(predicted: Column, reference: Column) -> Column:
    """Null where the reference is nearly zero."""
    return F.when(F.abs(reference) >= 1e-12, absolute_error(predicted, reference) / F.abs(reference))


def coverage(produced: Column, applicable: Column) -> Column:
    return F.when(applicable <= 0, 1.0).otherwise(clipped(produced / F.nullif(applicable, F.lit(0)), 0.0, 1.0))


def sound_interval(value: Column, lower: Column, upper: Column, slack: float = 1e-9) -> Column:
    finite = known(value).isNotNull() & known(lower).isNotNull() & known(upper).isNotNull()
    return finite & (lower <= value + slack) & (value - slack <= upper)


def corner_sigma(rmse_a: Column, rmse_b: Column, sine: Column, inferred: Column, extension: Column) -> Column:
    spread = (rmse_a * rmse_a + rmse_b * rmse_b) / F.pow(F.greatest(F.abs(sine), F.lit(0.1)), 2)
    return F.sqrt(spread + F.when(inferred, F.pow(0.5 * extension, 2)).otherwise(0.0) + 0.01**2)


def length_interval(length: Column, sigma_a: Column, sigma_b: Column, rmse: Column, scale: float = 0.0, pose: float = 0.0, depth: float = 0.0, level: float = 0.95) -> tuple[Column, Column]:
    """Lower and upper bound of a wall's length; the lower is 0.01 at least."""
    k = NORMAL_95 if abs(level - 0.95) < 0.02 else 1.0
    sigma = F.sqrt(sigma_a * sigma_a + sigma_b * sigma_b + rmse * rmse + F.pow(length * scale, 2) + pose**2 + depth**2)
    return F.greatest(length - k * sigma, F.lit(0.01)), length + k * sigma


def wall_confidence(plane: Column, rmse: Column, inferred_corners: Column) -> Column:
    return clipped(plane * F.greatest(F.lit(0.5), 1 - rmse / 0.15) * F.pow(F.lit(0.85), inferred_corners), 0.10, 0.99)


def area_confidence(mean: Column, support: Column, inferred_share: Column, provisional: Column) -> Column:
    value = mean * support * F.greatest(F.lit(0.5), 1 - 0.25 * inferred_share) * F.when(provisional, 0.9).otherwise(1.0)
    return clipped(value, 0.10, 0.99)


def plane_confidence(inliers: Column, rmse: Column) -> Column:
    value = 0.6 * clipped(inliers / 15000.0, 0.1, 1.0) + 0.4 * clipped(1 - rmse / 0.03, 0.1, 1.0)
    return F.round(clipped(value, 0.10, 0.99), 3)
