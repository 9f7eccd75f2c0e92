"""Cutting lineage where a loop would otherwise plan all its rounds anew."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys to as many partitions as a shuffle has, for groups whose Python work is long: adaptive execution would join them by their few bytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir; a temporary one only for local sessions that name none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="planimetra-"))
    return df.checkpoint()
