"""Labels, pictures and live clouds against plain loops."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from planimetra.functions import pictures
from planimetra.operators import imaging, labelling, points
from planimetra.plans import catalog
from planimetra.streaming import captures

LABEL = "place int, label_id long, text string, font double, priority double, x double, y double, x1 double, y1 double, x2 double, y2 double"


def greedy(labels, most=None):
    """One label after another, as long as there is room."""
    out, taken = {}, []
    for label in sorted((r for r in labels if None not in r[2:7]), key=lambda r: (r[4], r[1])):
        _, name, text, font, _, x, y, x1, y1, x2, y2 = label
        spots = [(x, y)]
        if None not in (x1, y1, x2, y2):
            n = math.hypot(x2 - x1, y2 - y1)
            for k in (1, 2, 3):
                mx, my, far = (x1 + x2) / 2, (y1 + y2) / 2, 0.15 + 0.15 * k
                spots.append((mx, my) if n < 1e-4 else (mx - (y2 - y1) / n * far, my + (x2 - x1) / n * far))
        w, h = font * 0.55 * len(text) + font * 0.6, font * 1.4
        out[name] = (False, x, y)
        if most is not None and len(taken) >= most:
            continue
        for px, py in spots:
            box = (px - w / 2, py - h / 2, w, h)
            if not any(box[0] < b[0] + b[2] + 0.02 and b[0] < box[0] + w + 0.02 and box[1] < b[1] + b[3] + 0.02 and b[1] < box[1] + h + 0.02 for b in taken):
                taken.append(box)
                out[name] = (True, px, py)
                break
    return out | {r[1]: (False, r[5], r[6]) for r in labels if None in r[2:7]}


def close(got, want):
    assert set(got) == set(want)
    for k, (shown, x, y) in want.items():
        assert got[k][0] == shown and (x is None or abs(got[k][1] - x) < 1e-9 and abs(got[k][2] - y) < 1e-9), k


def test_labels_equal_one_after_another(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        place = i % 2
        x, y = rng.uniform(0, 5), rng.uniform(0, 4)
        wall = (x - rng.uniform(0, 1), y, x + rng.uniform(0, 1), y + rng.uniform(-1, 1)) if i % 3 else (None,) * 4
        rows.append((place, i, "x" * rng.randint(1, 9), 0.2, float(rng.randint(0, 6)), x, y, *wall))
    rows += [(0, 900, None, 0.2, 1.0, 0.0, 0.0, None, None, None, None), (0, 901, "a", 0.2, None, 1.0, 1.0, None, None, None, None), (1, 902, "abc", 0.2, -1.0, 2.0, 2.0, 2.0, 2.0, 2.0, 2.0)]
    table = spark.createDataFrame(rows, LABEL)
    for most in (None, 12):
        got = {(r.place, r.label_id): (r.visible, r.x, r.y) for r in labelling.placed(table, ["place"], most).collect()}
        want = {(p, k): v for p in (0, 1) for k, v in greedy([r for r in rows if r[0] == p], most).items()}
        close(got, want)
    assert 20 < sum(v[0] for v in want.values()) <= 24
    assert labelling.placed(table.limit(0), ["place"]).count() == 0


def test_label_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in catalog._wall_labels(spark, sf).collect()]
    got = {(r.property_id, r.label_id): (r.visible, r.x, r.y) for r in catalog.QUERIES["t8_label_places"](spark, sf).collect()}
    want = {}
    for p in {r[0] for r in rows}:
        want |= {(p, k): (s, round(x, 6), round(y, 6)) for k, (s, x, y) in greedy([r for r in rows if r[0] == p], 15).items()}
    assert set(got) == set(want) and all(got[k][0] == w[0] and abs(got[k][1] - w[1]) < 2e-6 for k, w in want.items())


def test_pictures_equal_double_loops():
    rng = np.random.default_rng(2)
    for shape in ((7, 9), (2, 2), (1, 5), (4, 1)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        h, w = shape
        mirrored = min(shape) > 1
        at = lambda y, x: float(image[(abs(y) if y < h else 2 * h - 2 - y) if mirrored else min(max(y, 0), h - 1), (abs(x) if x < w else 2 * w - 2 - x) if mirrored else min(max(x, 0), w - 1)])  # noqa: E731, B023
        lap = [at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for y in range(h) for x in range(w)]
        grad = []
        for y in range(h):
            for x in range(w):
                gx = sum(k * (at(y + j, x + 1) - at(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
                gy = sum(k * (at(y + 1, x + j) - at(y - 1, x + j)) for j, k in ((-1, 1), (0, 2), (1, 1)))
                grad.append(math.hypot(gx, gy))
        assert abs(pictures.sharpness(image) - np.var(lap)) < 1e-6 and abs(pictures.texture(image) - min(100, 2 * np.mean(grad))) < 1e-9
    wide = rng.integers(0, 256, (3, 1280)).astype(np.uint8)
    small = pictures.bounded(wide)
    assert small.shape == (2, 640) and pictures.shrunk(np.full((5, 7), 9), 3, 2).tolist() == [[9.0] * 3] * 2
    assert np.array_equal(pictures.shrunk(wide[:2], 640, 1)[0], np.rint(wide[:2].reshape(2, 640, 2).mean(axis=(0, 2))))


def test_image_measures(spark):
    rng = np.random.default_rng(4)
    images = [rng.integers(0, 256, (6, 8)).astype(np.uint8) for _ in range(3)]
    rows = [("v", k, 8, 6, i.ravel().tolist()) for k, i in enumerate(images)] + [("v", 3, 8, 6, None), ("v", 4, 8, 6, [1, 2]), ("w", 0, 2, 2, [0, 0, 0, 0]), ("w", 1, None, 2, [255] * 4)]
    got = {(r.video, r.frame): r for r in imaging.image_measures(spark.createDataFrame(rows, "video string, frame int, width int, height int, pixels array<int>"), "video").collect()}
    for k, image in enumerate(images):
        r = got["v", k]
        assert abs(r.sharpness - pictures.sharpness(image)) < 1e-9 and abs(r.mean - image.mean()) < 1e-9 and r.exposed
        assert abs(r.motion - (pictures.difference(images[k - 1], image) if k else 0.0)) < 1e-9
    assert [(got[k].sharpness, got[k].exposed, got[k].motion) for k in (("v", 3), ("v", 4), ("w", 0), ("w", 1))] == [(0.0, False, 0.0)] * 4


def test_live_cloud_equals_the_whole(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k % 2, rng.randrange(6), *(round(rng.uniform(-1, 1), 3) for _ in range(3))) for k in range(900)]
    odd = [(0, 1, None, 0.0, 0.0), (0, 1, float("nan"), 0.0, 0.0), (1, None, 0.1, 0.1, 0.1)]
    schema = "capture_id int, view_id int, x double, y double, z double"
    source = str(tmp_path / "frames")
    for k in range(4):  # a file is a frame's worth of points
        spark.createDataFrame(rows[k::4] + (odd if k == 2 else []), schema).coalesce(1).write.mode("append").parquet(source)
    stream = captures.live_voxels(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), 0.4)
    out = str(tmp_path / "updates")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, _: df.write.mode("append").parquet(out)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    updates = spark.read.parquet(out)
    got = captures.closed_voxels(updates.unionByName(updates))
    whole = spark.createDataFrame(rows + odd[2:], schema)
    want = {tuple(r) for r in catalog.rounded(points.voxels(whole, 0.4, ["capture_id"]).select("capture_id", "vx", "vy", "vz", "n_points", "x", "y", "z"), "x", "y", "z").collect()}
    assert {tuple(r) for r in catalog.rounded(got.drop("n_views"), "x", "y", "z").collect()} == want and updates.count() > len(want)
    views = whole.groupBy("capture_id", *[F.floor(F.col(c) / 0.4).cast("long").alias(f"v{c}") for c in "xyz"]).agg(F.count_distinct("view_id").alias("n"))
    assert {tuple(r) for r in got.select("capture_id", "vx", "vy", "vz", "n_views").collect()} == {tuple(r) for r in views.collect()}


def test_a_long_chain_of_labels_is_one_pass(spark):
    # each label covers the next one's own place, so rounds of decided neighbours would be as many as labels
    rows = [(i % 3, i, "xxxx", 0.2, float(i), i * 0.05, 0.0, None, None, None, None) for i in range(600)]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("labels", "labels")
    found = labelling.placed(spark.createDataFrame(rows, LABEL), ["place"])
    got = {(r.place, r.label_id): (r.visible, r.x, r.y) for r in found.collect()}
    assert len(jobs.getJobIdsForGroup("labels")) <= 3
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    close(got, {(p, k): v for p in range(3) for k, v in greedy([r for r in rows if r[0] == p]).items()})
