"""Capture archives with two scans, odd members and broken ones."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pytest

from planimetra.operators import points
from planimetra.sources import archives

SHAPE = (12, 16)


def png(image: np.ndarray, filters=(0,)) -> bytes:
    """A grey image whose rows are coded by the given filters in turn."""
    step = image.dtype.itemsize
    rows = image.astype(f">u{step}").view(np.uint8).reshape(len(image), -1).astype(int)
    body, above = b"", np.zeros(rows.shape[1], int)
    for y, row in enumerate(rows):
        kind, out = filters[y % len(filters)], []
        for i, v in enumerate(row):
            a, b, c = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
            p = a + b - c
            guess = (0, a, b, (a + b) // 2, [a, b, c][int(np.argmin([abs(p - a), abs(p - b), abs(p - c)]))])[kind]
            out.append((v - guess) % 256)
        body, above = body + bytes([kind]) + bytes(out), row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8 * step, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def depth(k):
    return (np.arange(SHAPE[0] * SHAPE[1]).reshape(SHAPE) * 37 % 4000 + k).astype(np.uint16)


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("archives") / "two.zip")
    pose = "{t},{f:06d},{x},0,1,0,0,0,1"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for scan, n in (("one", 6), ("two", 3)):
            z.writestr(f"{scan}/odometry.csv", "timestamp, frame, x, y, z, qx, qy, qz, qw\n" + "\n".join(pose.format(t=10 + k, f=k, x=k / 10) for k in range(n)) + "\n\n")
            for k in range(n):
                image = depth(k) if (scan, k) != ("two", 1) else depth(k)[:5]
                z.writestr(zipfile.ZipInfo(f"{scan}/depth/{k:06d}.png"), png(image, (0, 1, 2, 3, 4)))
                if (scan, k) != ("one", 2):
                    z.writestr(f"{scan}/confidence/{k:06d}.png", png((depth(k) % 3).astype(np.uint8), (4, 1)))
        z.writestr("one/camera_matrix.csv", "1500, 0, 960\r\n0, 1400, 720\r\n0, 0, 1\r\n")
        z.writestr("two/camera_matrix.csv", "1500,0\n0,1400,720\n0,0,1\n")
        z.writestr("three/odometry.csv", "timestamp,frame\n")
        z.writestr("readme.txt", "hello")
    return path


def test_png_filters():
    image = depth(5)
    assert all(np.array_equal(archives.gray(png(image, f)), image) for f in ((0,), (1,), (2,), (3,), (4,), (0, 4, 3, 2, 1)))
    assert archives.gray(b"") is None and archives.gray(png(image)[:60]) is None and archives.gray(b"\x89PNG\r\n\x1a\nxxxx") is None


def test_members_are_read_by_their_place(spark, archive):
    read = archives.members(spark, archive)
    with zipfile.ZipFile(archive) as z:
        want = {n: z.read(n) for n in z.namelist()}
    rows = read.collect()
    assert {r.member: bytes(r.content) for r in rows} == want and len(rows) == len(want) and {r.reason for r in rows} == {None}
    assert {(r.scan_id, r.kind) for r in rows if r.kind != "other"} == {(s, k) for s in ("one", "two") for k in ("odometry", "camera_matrix", "depth", "confidence")} | {("three", "odometry")}
    reader = archives.ArchiveReader({"paths": json.dumps([archive])})
    assert [{archives.described(m[0])[0] for m in p.members} for p in reader.partitions()] == [{None}, {"one"}, {"three"}, {"two"}]
    assert len(archives.ArchiveReader({"paths": json.dumps([archive]), "bytes": "700"}).partitions()) > 6
    assert read.rdd.getNumPartitions() == 4


def test_scans_and_kinds_are_read_alone(spark, archive):
    found = archives.members(spark, archive, scans=("two",), kinds=("depth",))
    assert {r.member for r in found.collect()} == {f"two/depth/{k:06d}.png" for k in range(3)} and found.rdd.getNumPartitions() == 1
    assert archives.members(spark, archive, scans=("nine",)).count() == 0


def test_scans(spark, archive):
    scans = archives.Captures(spark, (archive,))
    got = {r.scan_id: (r.matrix, r.reason) for r in archives.camera_matrices(scans).collect()}
    assert got == {"one": ([1500, 0, 960, 0, 1400, 720, 0, 0, 1], None), "two": (None, "camera_matrix_shape"), "three": (None, "missing_camera_matrix")}
    poses = archives.odometry(scans).collect()
    assert sorted((r.scan_id, r.row, r.frame, r.ts_s, r.x, r.fx) for r in poses)[1] == ("one", 1, "000001", 11.0, 0.1, None) and len(poses) == 9


def test_frames(spark, archive):
    scans, one_scan = archives.Captures(spark, (archive,)), archives.Captures(spark, (archive,), ("one",))
    got = {(r.scan_id, r.frame): r for r in archives.frames(scans, shape=SHAPE).collect()}
    assert set(got) == {("one", f"{k:06d}") for k in (0, 1, 3, 4, 5)} | {("two", f"{k:06d}") for k in range(3)}
    one = got["one", "000004"]
    assert one.reason is None and one.depth_mm == depth(4).ravel().tolist() and one.confidence == (depth(4) % 3).ravel().tolist()
    assert (one.fx, one.fy, one.cx, one.cy) == pytest.approx((1500 * 16 / 1920, 1400 * 12 / 1440, 8, 6))
    assert got["two", "000001"].reason == "unexpected_depth_shape" and got["two", "000000"].reason == "camera_matrix_shape"
    few = archives.frames(one_scan, stride=2, most=1, shape=SHAPE).collect()
    assert [r.frame for r in few] == ["000000"]
    assert {r.frame for r in archives.frames(one_scan, stride=2, shape=SHAPE).collect()} == {"000000", "000004"}
    flat = archives.pixels(archives.frames(scans, shape=SHAPE).filter("frame = '000004' and scan_id = 'one'"), SHAPE[1])
    assert {(r.u, r.v, r.depth_mm) for r in flat.collect()} == {(u, v, int(depth(4)[v, u])) for u in range(16) for v in range(12)}
    assert points.unproject(flat).count() == int((depth(4) >= 200).sum())


def test_broken_members(spark, archive, tmp_path):
    data = bytearray(open(archive, "rb").read())
    with zipfile.ZipFile(archive) as z:
        hurt, lost = z.getinfo("one/depth/000001.png"), z.getinfo("two/odometry.csv")
    data[hurt.header_offset + 30 + len(hurt.filename) + 40] ^= 255
    data[lost.header_offset] = 0
    path = tmp_path / "broken.zip"
    path.write_bytes(bytes(data))
    got = {r.member: r.reason for r in archives.members(spark, str(path)).collect() if r.reason}
    assert got == {"one/depth/000001.png": "broken_member", "two/odometry.csv": "no_member_header"}
    both = archives.Captures(spark, (archive, str(path)))
    assert both.members().select("archive").distinct().count() == 2
    assert {r.reason for r in archives.frames(both, shape=SHAPE).filter("frame = '000001' and scan_id = 'one'").collect()} == {None, "broken_member"}
