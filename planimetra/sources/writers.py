"""Sinks: point clouds, documents and summaries, written by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_cloud(points: DataFrame, path: str, colours: bool = False) -> None:
    """ASCII PLY: a header file that sorts before the parts of points, so that their concatenation is one cloud."""
    n = points.count()
    fields = [f"property double {c}" for c in "xyz"] + [f"property uchar {c}" for c in ("red", "green", "blue") if colours]
    header = "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *fields, "end_header"])
    points.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/0-header")
    names = ["x", "y", "z", *(["r", "g", "b"] if colours else [])]
    points.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in names]).alias("value")).write.mode("overwrite").text(f"{path}/1-points")


def documents(rows: DataFrame, path: str) -> None:
    """One JSON document a row."""
    rows.write.mode("overwrite").json(path, ignoreNullFields=False)


def json_text(rows: DataFrame, key: str) -> DataFrame:
    """key and the row as a JSON text, nulls kept: missing evidence is a value."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("document"))


def summary(rows: DataFrame, path: str) -> None:
    """The benchmark's table with its fixed seven columns."""
    names = {"tier": "Tier", "metric": "Metric", "value": "Value", "unit": "Unit", "evidence_level": "Evidence_Level", "status": "Status", "notes": "Notes"}
    rows.select(*[F.col(c).cast("string").alias(n) for c, n in names.items()]).write.mode("overwrite").csv(path, header=True)


def sampled_trajectory(poses: DataFrame, step: int = 10, decimals: int = 4) -> DataFrame:
    """Every step-th pose, rounded."""
    return poses.filter(F.col("frame") % step == 0).select("trajectory_id", "frame", *[F.round(c, decimals).alias(c) for c in ("ts_s", "x", "y", "z")])


def loop_document(decisions: DataFrame) -> DataFrame:
    """Counts of decisions beside the decisions themselves."""
    count = lambda d: F.count_if(F.col("decision") == d).alias(d)
    return decisions.groupBy("trajectory_id").agg(count("accepted"), count("uncertain"), count("rejected"), F.sort_array(F.collect_list(F.struct("source", "target", "decision", "reasons"))).alias("loops"))
