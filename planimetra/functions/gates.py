"""Quality gates: every gate gives a status and the reasons for it, as values rather than errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reasons(**failed: Column) -> Column:
    """Names of the conditions that hold, in order; a condition that is null does not."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in failed.items()]), lambda r: r.isNotNull())


def first_reason(**failed: Column) -> Column:
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in failed.items()], F.lit(None).cast("string"))


def status(found: Column, passed: str, failed: str) -> Column:
    return F.when(F.size(found) == 0, F.lit(passed)).otherwise(F.lit(failed))
