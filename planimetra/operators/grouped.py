"""Ordered folds over small groups, many groups to an Arrow batch: no pandas frame is built for a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(df: DataFrame, keys: list[str], order: str, coordinates: list[str], label: Callable[[np.ndarray], list[int]], name: str) -> DataFrame:
    """df with a label of each row, which label() gives for the coordinates of a group in order. Groups are small by nature."""
    row = F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("_r"))
    packed = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    places = F.transform("_rows", lambda r: F.array(*[r["_r"][c].cast("double") for c in coordinates]))

    def run(groups: pd.Series) -> pd.Series:
        return pd.Series([label(np.array([list(p) for p in g], float).reshape(-1, len(coordinates))) for g in groups], dtype=object)

    given = packed.withColumn("_labels", F.pandas_udf(run, "array<long>")(places))
    return given.select(F.explode(F.arrays_zip("_rows", "_labels")).alias("_z")).select("_z._rows._r.*", F.col("_z._labels").alias(name))
