"""Readers of capture and evaluation inputs, with fixed schemas. Everything goes through Spark's own file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ODOMETRY = "timestamp double, frame int, x double, y double, z double, qx double, qy double, qz double, qw double, fx double, fy double, cx double, cy double"
GROUND_TRUTH = "measurement_id string, room_id string, measurement_type string, value string, unit string, source string, notes string"
INCUMBENT = "room_id string, measurement_id string, measurement_type string, incumbent_value string, unit string, notes string"
PHOTO_SUFFIXES = ("jpg", "jpeg", "png", "heic", "heif")
VIDEO_SUFFIXES = ("mp4", "mov", "m4v")


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).limit(1).collect()
    return [c.strip().lower() for c in first[0].value.lstrip("﻿").split(",")] if first else []


def _by_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of schema, found by the names in the file's header; those that it lacks are null."""
    types = dict(f.strip().rsplit(" ", 1) for f in schema.split(","))
    names = _header(spark, path)
    raw = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names), header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True) if names else spark.createDataFrame([], "_ string")
    return raw.select(*[(F.col(n).try_cast(t) if n in names else F.lit(None).cast(t)).alias(n) for n, t in types.items()])


def odometry(spark: SparkSession, path: str) -> DataFrame:
    """Poses by header; the quaternion is xyzw. Blank lines are skipped; an empty file is an error."""
    rows = _by_header(spark, path, ODOMETRY).filter("frame is not null or timestamp is not null").withColumnRenamed("timestamp", "ts_s")
    if rows.isEmpty():
        raise ValueError(f"no odometry rows in {path}")
    return rows


def frame_count(poses: DataFrame) -> int:
    """Number of odometry rows."""
    return poses.count()


def camera_matrix(spark: SparkSession, path: str) -> list[list[float]]:
    rows = [tuple(r) for r in spark.read.csv(path, schema="a double, b double, c double").limit(4).collect()]
    if len(rows) != 3 or any(x is None for r in rows for x in r):
        raise ValueError(f"{path} is not a 3x3 matrix")
    return [list(r) for r in rows]


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, name, suffix and size of files, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"name": name, "suffix": F.lower(F.element_at(F.split(name, r"\."), -1))})


def photos(spark: SparkSession, path: str, most: int = 8) -> DataFrame:
    """Photos by name without case; the first most are selected, the others omitted."""
    found = listing(spark, path).filter(F.col("suffix").isin(*PHOTO_SUFFIXES))
    rank = F.row_number().over(Window.orderBy(F.lower("name"), "name"))
    return found.withColumns({"rank": rank, "status": F.when(rank <= most, "selected").otherwise("omitted")})


def usable_frames(frames: DataFrame, depth: DataFrame, confidence: DataFrame, stride: int = 1, most: int | None = None) -> DataFrame:
    """Every stride-th frame that has both depth and confidence; most counts only frames that are left."""
    order = Window.orderBy("frame")
    strided = frames.withColumn("_i", F.row_number().over(order) - 1).filter(F.col("_i") % stride == 0).drop("_i")
    both = strided.join(depth, "frame", "left_semi").join(confidence, "frame", "left_semi")
    return both.orderBy("frame").limit(most) if most is not None else both


def ground_truth(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reference measurements of all paths; a wrong header or a path under templates is an error."""
    out = None
    for path in paths:
        if "templates" in path.split("/"):
            raise ValueError(f"{path} is a template")
        missing = {"measurement_id", "room_id", "measurement_type", "value", "unit"} - set(_header(spark, path))
        if missing:
            raise ValueError(f"{path} lacks {sorted(missing)}")
        rows = _by_header(spark, path, GROUND_TRUTH)
        out = rows if out is None else out.unionByName(rows)
    trimmed = out.select(*[F.trim(c).alias(c) for c in out.columns])
    return trimmed.withColumns({"measurement_type": F.lower("measurement_type"), "value": F.col("value").try_cast("double")})


def of_room(truth: DataFrame, room: str) -> DataFrame:
    return truth.filter(F.lower("room_id") == room.lower())


def incumbent(spark: SparkSession, path: str) -> DataFrame:
    """Values of another product; templates and files with another header are empty, bad rows are dropped."""
    empty = spark.createDataFrame([], INCUMBENT.replace("incumbent_value string", "incumbent_value double"))
    if "template" in path.rsplit("/", 1)[-1].lower() or not {"room_id", "measurement_id", "measurement_type", "incumbent_value"} <= set(_header(spark, path)):
        return empty
    rows = _by_header(spark, path, INCUMBENT).withColumn("incumbent_value", F.col("incumbent_value").try_cast("double"))
    return rows.filter("room_id is not null and measurement_id is not null and incumbent_value is not null")


def point_cloud(spark: SparkSession, path: str, least: int = 1000, widest: float = 50.0) -> DataFrame:
    """x, y, z of an ASCII PLY cloud; an error if there are too few, not finite or too widespread points."""
    rows = spark.read.text(path, wholetext=False).select(F.split(F.trim("value"), r"\s+").alias("v"))
    number = lambda i: F.get("v", F.lit(i)).try_cast("double")
    points = rows.select(number(0).alias("x"), number(1).alias("y"), number(2).alias("z")).filter("x is not null and y is not null and z is not null")
    check = points.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("x") | F.isnan("y") | F.isnan("z") | (F.greatest(F.abs("x"), F.abs("y"), F.abs("z")) == float("inf"))).alias("bad"), F.greatest(*[F.max(c) - F.min(c) for c in "xyz"]).alias("span")).first()
    if check.n < least or check.bad or check.span > widest:
        raise ValueError(f"{path}: {check.n} points, {check.bad} not finite, span {check.span}")
    return points


def archive_contents(files: DataFrame) -> DataFrame:
    """Counts of members by kind of each archive (archive, name)."""
    kind = lambda p: F.count_if(F.col("name").like(p))
    return files.groupBy("archive").agg(kind("%odometry.csv").alias("odometry"), kind("%camera_matrix.csv").alias("camera_matrix"), kind("%/depth/%.png").alias("depth"), kind("%/confidence/%.png").alias("confidence"), kind("%rgb.mp4").alias("video"), F.count(F.lit(1)).alias("members"))


def upload_verdict(uploads: DataFrame, largest: int = 2 * 1024**3) -> DataFrame:
    """Adds the reason for which an upload (tier, name, size) is refused; null if it is fine."""
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    wanted = F.when(F.col("tier") == "lidar", suffix == "zip").when(F.col("tier") == "video", suffix.isin(*VIDEO_SUFFIXES)).when(F.col("tier") == "photo", suffix.isin("zip", *PHOTO_SUFFIXES)).otherwise(False)
    return uploads.withColumn("reason", F.when(F.col("size") <= 0, "empty").when(F.col("size") > largest, "too_large").when(~wanted, "wrong_type"))


def exif_values(tags: DataFrame) -> DataFrame:
    """Flattens EXIF entries (name, text, numerator, denominator, is_binary): rationals as numbers, binary ones dropped."""
    return tags.filter("not is_binary").select("name", F.coalesce((F.col("numerator") / F.nullif(F.col("denominator"), F.lit(0))).cast("string"), F.col("text")).alias("value"))
