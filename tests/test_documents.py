"""Documents of unknown shape."""

import json

import pytest
from pyspark.sql import functions as F

from planimetra.functions import documents

CASES = [
    ({"rooms": [{"room_id": "a"}]}, "property", None),
    ({"room_polygon": {"vertices": []}}, "single_room", None),
    ({"measurements": [], "rooms": [1]}, "single_room", None),
    ({"room_polygon": None, "measurements": ""}, "property", None),
    ({"room_polygon": 0, "measurements": False}, "property", None),
    ({"status": "NOT_EVALUABLE", "measurements": [1], "failure_reasons": ["dark", None, "blurred"]}, "failure", ["dark", "blurred"]),
    ({"status": "NOT_EVALUABLE"}, "failure", []),
    ({"status": 7, "rooms": [], "failure_reasons": []}, "failure", []),
    ({"rooms": [], "failure_reasons": "none"}, "property", None),
    ([1, 2], "property", None),
    ("text", "failure", ["empty_payload"]),
    (None, "failure", ["empty_payload"]),
    (3, "failure", ["empty_payload"]),
]


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("d", documents.parsed(F.col("text")))


def test_every_shape_reaches_its_branch(spark):
    table = rows(spark, [json.dumps(c[0]) for c in CASES] + ["{broken", None])
    got = {r.i: (r.r, r.f) for r in table.select("i", documents.route(F.col("d")).alias("r"), documents.failure_reason(F.col("d")).alias("f")).collect()}
    assert got == dict(enumerate([c[1:] for c in CASES] + [("failure", ["empty_payload"])] * 2))


@pytest.mark.parametrize(("tier", "want"), [("video", ["PROVISIONAL"] * 4 + ["NOT_EVALUABLE", "FAILED", "PROVISIONAL", "PROVISIONAL", "PROVISIONAL"]), ("lidar", ["COMPLETE"] * 3 + ["PROVISIONAL", "NOT_EVALUABLE", "FAILED", "FAILED", "COMPLETE", "COMPLETE"]), ("photo", ["COMPLETE"] * 3 + ["PROVISIONAL", "NOT_EVALUABLE", "FAILED", "FAILED", "PROVISIONAL", "PROVISIONAL"])])
def test_statuses(spark, tier, want):
    texts = ['"complete"', '"Accepted"', '"SUCCEEDED"', '"provisional"', '"not_evaluable"', '"failed"', '"rejected"', '"odd"', "5"]
    got = rows(spark, texts).select("i", documents.normal_status(F.col("d"), F.lit(tier)).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == want


def test_values(spark):
    cases = [
        (3, (3.0, "m", None, None, None, None)), (2.5, (2.5, "m", None, None, None, None)), ({"value": 1, "unit": "ft", "lower_bound": 0.5, "upper_bound": 2}, (1.0, "ft", 0.5, 2.0, None, None)),
        ({"value": 1, "interval": [0, 3], "confidence": 0.9, "method": "laser"}, (1.0, "m", 0.0, 3.0, 0.9, "laser")), ({"value": 1, "interval": [0, "x"], "lower_bound": 0.2}, (1.0, "m", 0.2, None, None, None)),
        ({"value": "1"}, None), ({"unit": "m"}, None), ("3", None), (None, None), ([1], None), (True, None), ({"value": 1, "unit": 3, "confidence": "high"}, (1.0, "m", None, None, None, None)),
    ]
    got = rows(spark, [json.dumps(c) for c, _ in cases]).select("i", documents.measured(F.col("d")).alias("v")).orderBy("i").collect()
    assert [None if r.v is None else tuple(r.v) for r in got] == [w for _, w in cases]
