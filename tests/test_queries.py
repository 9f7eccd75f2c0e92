"""Every query of the catalog against its SQL on the smallest tables, sources, sinks and streams."""

import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from planimetra.plans import catalog
from planimetra.sources import readers, writers
from planimetra.streaming import captures

SF = "/root/testdata/sf0.001"


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, got) == rows(names, want.fetchall())


def test_readers(spark, tmp_path):
    (tmp_path / "odometry.csv").write_text("timestamp, frame, x, y, z, qx, qy, qz, qw\n1.5, 0, 1, 2, 3, 0, 0, 0, 1\n\n2.5, 1, 2, 2, 3, 0, 0, 0, 1\n")
    poses = readers.odometry(spark, str(tmp_path / "odometry.csv")).orderBy("frame").collect()
    assert [(p.frame, p.ts_s, p.x, p.fx) for p in poses] == [(0, 1.5, 1.0, None), (1, 2.5, 2.0, None)]
    (tmp_path / "camera.csv").write_text("1,0,2\n0,3,4\n0,0,1\n")
    assert readers.camera_matrix(spark, str(tmp_path / "camera.csv"))[1] == [0, 3, 4]
    (tmp_path / "short.csv").write_text("1,0,2\n0,3,4\n")
    with pytest.raises(ValueError):
        readers.camera_matrix(spark, str(tmp_path / "short.csv"))
    (tmp_path / "gt.csv").write_text("measurement_id,room_id,measurement_type,value,unit,source,notes\nw1,Room_1, Wall_Length ,4.2,m,tape,\nw2,room_2,ceiling_height,bad,m,tape,\n")
    truth = readers.ground_truth(spark, [str(tmp_path / "gt.csv")])
    assert [(r.measurement_type, r.value) for r in truth.orderBy("measurement_id").collect()] == [("wall_length", 4.2), ("ceiling_height", None)]
    assert readers.of_room(truth, "ROOM_1").count() == 1
    with pytest.raises(ValueError):
        readers.ground_truth(spark, [str(tmp_path / "camera.csv")])
    (tmp_path / "inc.csv").write_text("room_id,measurement_id,measurement_type,incumbent_value,unit,notes\nr,w1,wall_length,4.1,m,\nr,w2,wall_length,x,m,\n")
    assert readers.incumbent(spark, str(tmp_path / "inc.csv")).count() == 1
    assert readers.incumbent(spark, str(tmp_path / "gt.csv")).count() == 0
    for name in ("b.JPG", "a.png", "c.txt", "D.heic"):
        (tmp_path / "photos").mkdir(exist_ok=True)
        (tmp_path / "photos" / name).write_text("x")
    assert [(r.name, r.status) for r in readers.photos(spark, str(tmp_path / "photos"), 2).orderBy("rank").collect()] == [("a.png", "selected"), ("b.JPG", "selected"), ("D.heic", "omitted")]


def test_frames_and_uploads(spark):
    frames = spark.range(10).select(F.col("id").cast("int").alias("frame"))
    depth, confidence = frames.filter("frame != 4"), frames.filter("frame != 2")
    assert [r.frame for r in readers.usable_frames(frames, depth, confidence, 2, 2).collect()] == [0, 6]
    uploads = spark.createDataFrame([("lidar", "a.zip", 5), ("lidar", "a.txt", 5), ("video", "v.mp4", 0), ("photo", "p.heic", 3 * 1024**3)], "tier string, name string, size long")
    assert [r.reason for r in readers.upload_verdict(uploads).collect()] == [None, "wrong_type", "empty", "too_large"]
    tags = spark.createDataFrame([("f", None, 28, 10, False), ("b", "x", None, None, True), ("m", "cam", None, None, False)], "name string, text string, numerator int, denominator int, is_binary boolean")
    assert {r.name: r.value for r in readers.exif_values(tags).collect()} == {"f": "2.8", "m": "cam"}


def test_writers(spark, tmp_path):
    cloud = spark.range(1200).select((F.col("id") % 10).cast("double").alias("x"), (F.col("id") / 100).alias("y"), F.lit(0.5).alias("z"))
    writers.point_cloud(cloud, str(tmp_path / "cloud"))
    again = readers.point_cloud(spark, str(tmp_path / "cloud" / "*"))
    assert again.count() == 1200 and abs(again.agg(F.sum("y")).first()[0] - cloud.agg(F.sum("y")).first()[0]) < 1e-6
    with pytest.raises(ValueError):
        readers.point_cloud(spark, str(tmp_path / "cloud" / "*"), least=5000)
    doc = spark.createDataFrame([("r", None)], "room_id string, height double")
    assert writers.json_text(doc, "room_id").first().document == '{"room_id":"r","height":null}'
    table = spark.createDataFrame([("lidar", "area", 1.0, "m2", "GT", "PASS", None)], "tier string, metric string, value double, unit string, evidence_level string, status string, notes string")
    writers.summary(table, str(tmp_path / "summary"))
    assert spark.read.csv(str(tmp_path / "summary"), header=True).columns == ["Tier", "Metric", "Value", "Unit", "Evidence_Level", "Status", "Notes"]


def test_streams(spark, tmp_path):
    poses = spark.range(40).select(F.lit(1).cast("long").alias("trajectory_id"), F.col("id").cast("int").alias("frame"), F.col("id").cast("double").alias("ts_s"), (F.col("id") * 0.1).alias("x"), *[F.lit(0.0).alias(c) for c in ("y", "z", "qx", "qy", "qz")], F.lit(1.0).alias("qw"))
    for part, low in enumerate((0, 20)):
        poses.filter((F.col("id") >= low) & (F.col("id") < low + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "poses"))
    source = spark.readStream.schema(poses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "poses"))
    run = captures.live_keyframes(source).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.frame for r in spark.table("live").collect()} == set(range(0, 40, 5))
    pixels = spark.range(100).select(F.timestamp_seconds(F.col("id")).alias("ts"), F.lit(1).alias("capture_id"), (F.col("id") % 3).alias("confidence"), (F.col("id") / 10).alias("depth"))
    pixels.write.parquet(str(tmp_path / "pixels"))
    run = captures.live_funnel(spark.readStream.schema(pixels.schema).parquet(str(tmp_path / "pixels"))).writeStream.format("memory").queryName("funnel").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    total = spark.table("funnel").agg(F.sum("pixels"), F.sum("confident"), F.sum("in_range")).first()
    assert tuple(total) == (100, 33, sum(1 for i in range(100) if i % 3 == 2 and 0.2 <= i / 10 <= 5))


def test_queries_do_the_references_whole_work(spark, monkeypatch):
    ring = spark.createDataFrame([(1, k, (k + 1) % 9, k) for k in range(9)], "capture_id long, source int, target int, wall_id int")
    cycles = catalog.graph.cycles
    monkeypatch.setattr(catalog.graph, "cycles", lambda edges, key, longest=9: cycles(ring, key, longest))
    assert [r.cycle for r in catalog.QUERIES["i1_wall_cycles"](spark, SF).collect()] == ["0-1-2-3-4-5-6-7-8"]
    monkeypatch.setattr(catalog.measure, "monte_carlo", lambda rooms, key, samples=1000, seed=42: samples)
    assert catalog.QUERIES["a10_monte_carlo"](spark, SF) == 1000
