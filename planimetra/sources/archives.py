"""Capture archives as tables: a data source that reads zip members by their place in the archive, and the scans in them.

The driver reads only an archive's directory. Members are dealt to tasks scan by scan in runs of bounded bytes; a task seeks to its own members and reads
nothing else, so a large archive is read by many tasks. Scans and kinds are options of a load, so members of others are left out before anything of them is read.
"""

from __future__ import annotations

import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

SCHEMA = "archive string, scan_id string, kind string, frame string, member string, size long, content binary, reason string"
#: Uncompressed bytes of a task's members; a larger member is a task of its own.
PARTITION_BYTES = 32 << 20
DEPTH_SHAPE = (192, 256)
#: Size of the colour frames that a camera matrix is given for.
COLOUR_SIZE = (1920, 1440)

_KINDS = {"camera_matrix.csv": "camera_matrix", "odometry.csv": "odometry", "rgb.mp4": "video", "imu.csv": "imu"}


def described(member: str) -> tuple[str | None, str, str | None]:
    """Scan, kind and frame of a member: scan/odometry.csv, scan/depth/000001.png."""
    parts = member.split("/")
    if len(parts) >= 3 and parts[-2] in ("depth", "confidence") and parts[-1].lower().endswith(".png"):
        return "/".join(parts[:-2]), parts[-2], parts[-1][:-4]
    return "/".join(parts[:-1]) or None, _KINDS.get(parts[-1], "other"), None


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


@dataclass
class Run(InputPartition):
    archive: str
    #: name, place, compressed size, size, method, checksum, flags
    members: list[tuple[str, int, int, int, int, int, int]]

    def __init__(self, archive: str, members: list):
        super().__init__(0)
        self.archive, self.members = archive, members


def _content(file, place: int, packed: int, size: int, method: int, checksum: int, flags: int) -> tuple[bytes | None, str | None]:
    """Bytes of a member, or the reason for which there are none."""
    if flags & 1:
        return None, "encrypted"
    file.seek(place)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        return None, "no_member_header"
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(place + 30 + name + extra)
    data = file.read(packed)
    if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return None, "unknown_compression"
    try:
        data = zlib.decompress(data, -15) if method == zipfile.ZIP_DEFLATED else data
    except zlib.error:
        return None, "broken_member"
    return (data, None) if len(data) == size and zlib.crc32(data) == checksum else (None, "broken_member")


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        given = {k.lower(): json.loads(v) for k, v in options.items() if k.lower() in ("paths", "scans", "kinds", "bytes")}
        self.paths, self.bytes = given["paths"], given.get("bytes", PARTITION_BYTES)
        # a filter pushed down would be shared by all scans of one load, which then miss what others leave out
        self.wanted = {k: set(given[o]) for k, o in (("scan_id", "scans"), ("kind", "kinds")) if given.get(o)}

    def partitions(self) -> list[Run]:
        out = []
        for path in self.paths:
            with _opened(path) as file, zipfile.ZipFile(file) as archive:
                own, scan, size = [], None, 0
                # in the order of the archive within a scan, so that a task reads forward
                for m in sorted((m for m in archive.infolist() if not m.is_dir()), key=lambda m: (described(m.filename)[0] or "", m.header_offset)):
                    scan_id, kind, _ = described(m.filename)
                    if any({"scan_id": scan_id, "kind": kind}[c] not in v for c, v in self.wanted.items()):
                        continue
                    if own and (scan_id != scan or size + m.file_size > self.bytes):
                        out.append(Run(path, own))
                        own, size = [], 0
                    own.append((m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC, m.flag_bits))
                    scan, size = scan_id, size + m.file_size
                if own:
                    out.append(Run(path, own))
        return out

    def read(self, partition: Run) -> Iterator[tuple]:
        if partition is None or not getattr(partition, "members", None):
            return
        with _opened(partition.archive) as file:
            for name, *place in partition.members:
                content, reason = _content(file, *place)
                yield (partition.archive, *described(name), name, place[2], content, reason)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def members(spark: SparkSession, *paths: str, scans: tuple[str, ...] = (), kinds: tuple[str, ...] = (), partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row a member of the archives, of these scans and kinds (all if none are named): archive, scan_id, kind, frame, member, size, content, reason.

    Kinds are camera_matrix, odometry, depth, confidence, video, imu and other. A member that cannot be read has no content but a reason: encrypted,
    unknown_compression, no_member_header, broken_member. Tasks need a way to open the paths: local ones must be on every machine.
    """
    spark.dataSource.register(ArchiveSource)
    options = {"paths": paths, "scans": scans, "kinds": kinds, "bytes": partition_bytes}
    return spark.read.format("capture_archive").options(**{k: json.dumps(v) for k, v in options.items()}).load()


def _lines(content: Column) -> Column:
    return F.filter(F.transform(F.split(F.decode(content, "UTF-8"), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


@dataclass
class Captures:
    """Scans of archives (all if none are named). Each table is a load of its own that reads only the members it needs."""

    spark: SparkSession
    paths: tuple[str, ...]
    scans: tuple[str, ...] = ()
    partition_bytes: int = PARTITION_BYTES

    def members(self, *kinds: str) -> DataFrame:
        return members(self.spark, *self.paths, scans=self.scans, kinds=kinds, partition_bytes=self.partition_bytes)


def camera_matrices(of: Captures) -> DataFrame:
    """archive, scan_id, matrix (9 numbers) and reason of each scan: missing_camera_matrix, or camera_matrix_shape if three rows of three numbers are not found."""
    rows = F.filter(F.transform(_lines(F.col("content")), lambda x: F.transform(F.filter(F.split(x, ","), lambda p: F.trim(p) != ""), lambda p: F.trim(p).try_cast("double"))), lambda r: F.size(r) == 3)
    matrix = F.flatten(rows)
    sound = (F.size(rows) == 3) & ~F.exists(matrix, lambda x: x.isNull())
    given = of.members("camera_matrix").select("archive", "scan_id", F.when(sound, matrix).alias("matrix"), F.when(F.col("reason").isNotNull(), F.col("reason")).when(~F.coalesce(sound, F.lit(False)), "camera_matrix_shape").alias("reason"))
    scans = of.members("odometry").select("archive", "scan_id").distinct()
    out = scans.join(given.withColumn("_given", F.lit(True)), ["archive", "scan_id"], "full_outer")
    return out.select("archive", "scan_id", "matrix", F.when(F.col("_given").isNull(), "missing_camera_matrix").otherwise(F.col("reason")).alias("reason"))


_POSE = ("timestamp", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")


def odometry(of: Captures) -> DataFrame:
    """archive, scan_id, row (from 0), frame (text, as members name it) and the numbers of each odometry line, by the names in its header; what is missing is null."""
    lines = of.members("odometry").filter("content is not null").select("archive", "scan_id", _lines(F.col("content")).alias("_l"))
    header = F.transform(F.split(F.get("_l", F.lit(0)), ","), lambda x: F.trim(x))
    told = lines.select("archive", "scan_id", header.alias("_h"), F.posexplode(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))).alias("row", "_v"))
    place = lambda c: F.array_position("_h", c).cast("int")
    value = lambda c: F.when(place(c) > 0, F.trim(F.get(F.split("_v", ","), place(c) - 1)))
    return told.select("archive", "scan_id", "row", value("frame").alias("frame"), *[value(c).try_cast("double").alias("ts_s" if c == "timestamp" else c) for c in _POSE])


def gray(data: bytes) -> np.ndarray | None:
    """Values of a grey PNG image of 8 or 16 bits without interlacing; None for anything else."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] != 0 or head[6] != 0:
        return None
    width, height, step = head[0], head[1], head[2] // 8
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    except zlib.error:
        return None
    if len(raw) != height * (1 + width * step):
        return None
    rows = raw.reshape(height, -1)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:]
        if kind == 0:
            above = line
        elif kind == 2:
            above = line + above
        elif kind == 1:
            above = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        else:
            above = _predicted(line.tolist(), above.tolist(), step, kind)
        out[y] = above
    return out if step == 1 else out.view(">u2").astype(np.uint16)


def _predicted(line: list[int], above: list[int], step: int, kind: int) -> np.ndarray:
    """A row whose bytes are told from the one before, above and both: by their mean, or the nearest to their plane."""
    out = [0] * len(line)
    for i, v in enumerate(line):
        a, b, c = (out[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        if kind == 3:
            out[i] = (v + (a + b) // 2) & 255
        else:
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
            out[i] = (v + near[2]) & 255
    return np.array(out, np.uint8)


def frames(of: Captures, stride: int = 1, most: int | None = None, shape: tuple[int, int] = DEPTH_SHAPE) -> DataFrame:
    """Every stride-th odometry row of each scan that has both depth and confidence: pose, depth_mm and confidence (arrays by rows), intrinsics scaled to the depth image, reason.

    Members that are missing skip the row; most counts the rows that are left, in order. Reasons instead of pixels: unreadable_image, unexpected_depth_shape, or
    why a scan has no camera matrix, where the row has no intrinsics of its own.
    """
    keys = ["archive", "scan_id"]
    poses = odometry(of).filter(F.col("row") % stride == 0)
    image = lambda k: of.members(k).select(*keys, "frame", F.col("content").alias(f"_{k}"), F.col("reason").alias(f"_{k}_reason"))
    both = poses.join(image("depth"), [*keys, "frame"]).join(image("confidence"), [*keys, "frame"])
    if most is not None:
        both = both.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("row"))).filter(F.col("_n") <= most).drop("_n")
    matrices = camera_matrices(of).withColumnRenamed("reason", "_matrix_reason")
    both = both.join(matrices, keys, "left")
    kept = [c for c in both.columns if c not in ("_depth", "_confidence", "_depth_reason", "_confidence_reason", "_matrix_reason", "matrix")]

    def decoded(depth, confidence):
        import pandas as pd

        out = []
        for d, c in zip(depth, confidence):
            pair = [None if x is None else gray(bytes(x)) for x in (d, c)]
            reason = "unreadable_image" if any(x is None for x in pair) else "unexpected_depth_shape" if pair[0].shape != shape or pair[1].shape != shape else None
            out.append((None, None, reason) if reason else (pair[0].ravel().astype(np.int32), pair[1].ravel().astype(np.int32), None))
        return pd.DataFrame(out, columns=["depth_mm", "confidence", "reason"])

    image_of = F.pandas_udf(decoded, "struct<depth_mm:array<int>,confidence:array<int>,reason:string>")
    own = F.col("fx").isNotNull() & (F.col("fx") != 0)
    scale = {"fx": shape[1] / COLOUR_SIZE[0], "cx": shape[1] / COLOUR_SIZE[0], "fy": shape[0] / COLOUR_SIZE[1], "cy": shape[0] / COLOUR_SIZE[1]}
    at = {"fx": 0, "cx": 2, "fy": 4, "cy": 5}
    lens = {c: F.when(own, F.col(c)).otherwise(F.get("matrix", F.lit(i))) * scale[c] for c, i in at.items()}
    told = both.withColumn("_i", image_of("_depth", "_confidence")).withColumn("reason", F.coalesce(F.col("_depth_reason"), F.col("_confidence_reason"), F.col("_i.reason"), F.when(~F.coalesce(own, F.lit(False)), F.col("_matrix_reason"))))
    return told.select(*[lens[c].alias(c) if c in lens else F.col(c) for c in kept], F.col("_i.depth_mm").alias("depth_mm"), F.col("_i.confidence").alias("confidence"), "reason")


def pixels(read: DataFrame, width: int = DEPTH_SHAPE[1]) -> DataFrame:
    """One row a pixel of frames() without a reason: u, v, depth_mm, confidence beside the other columns."""
    rest = [c for c in read.columns if c not in ("depth_mm", "confidence", "reason")]
    flat = read.filter("reason is null").select(*rest, F.posexplode(F.arrays_zip("depth_mm", "confidence")).alias("_at", "_p"))
    return flat.select(*rest, (F.col("_at") % width).alias("u"), F.floor(F.col("_at") / width).cast("int").alias("v"), F.col("_p.depth_mm").alias("depth_mm"), F.col("_p.confidence").alias("confidence"))
