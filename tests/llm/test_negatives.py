import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from planimetra.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, every=100, **more):
    table = spark.createDataFrame(rows, SCHEMA)
    return negatives.mine(negatives.prepared(table), F.col("vec_id") % every == 0, **more)


def brute(rows, every, positives=5, negatives_=10, lower=30, upper=90):
    """The same by plain loops over Python integers."""
    sound = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], y) for i, v, y in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (i, v, y) in enumerate(sound):
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), float("inf") if j is None else j, k) for k, (j, w, _) in enumerate(sound) if k != at)
        for s, j, k in [x for x in scored if sound[x[2]][2] == y][:positives]:
            found = [(-t, n) for t, n, m in scored if sound[m][2] != y and lower * -s <= 100 * -t <= upper * -s][:negatives_]
            out += [(i, None if j == float("inf") else j, r, None if n == float("inf") else n, -s, t) for r, (t, n) in enumerate(found, 1)]
    return sorted(out, key=str)


def vectors(n, seed=3, dims=6, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = []
    for i in range(n):
        y = rng.randrange(labels)
        rows.append((i, [c / 2 + rng.gauss(0, 0.7) for c in centres[y]], y))
    return rows


def awkward():
    rows = vectors(120)
    rows += [(1000, rows[3][1], rows[3][2])] + [(2000 + i, rows[7][1], i % 4) for i in range(40)]  # copies: ties
    rows += [(5, rows[5][1], rows[5][2])] * 2 + [(10, rows[10][1], rows[10][2])]  # repeated rows, anchors among them
    rows += [(700, None, 1), (701, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (710, [float("nan")] * 6, 2), (720, [float("inf")] + [0.0] * 5, 2), (730, rows[1][1], None)]
    rows += [(None, rows[2][1], 0), (None, rows[2][1], 3), (740, [0.0] * 6, 1), (750, [], 2), (760, [0.5, 0.25], 2), (-20, rows[9][1], 1)]
    return rows


def test_equals_plain_loops(spark):
    rows = awkward()
    assert sorted(map(tuple, mined(spark, rows, 10).collect()), key=str) == brute(rows, 10)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 7)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", 5)
    monkeypatch.setattr(negatives, "_CELLS", 20)
    assert sorted(map(tuple, mined(spark, rows, 10).collect()), key=str) == brute(rows, 10)


def test_one_vector_may_be_a_third_of_all(spark):
    rows = vectors(60)
    rows += [(100 + i, rows[0][1], i % 2) for i in range(200)]
    assert sorted(map(tuple, mined(spark, rows, 20).collect()), key=str) == brute(rows, 20)


def test_other_limits(spark):
    rows = vectors(80, seed=5)
    got = mined(spark, rows, 10, positives=2, negatives=3, lower=50, upper=100)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 10, 2, 3, 50, 100)


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1)], [(100, [0.5], 1)], [(100, [0.5], 1), (7, [0.5], 2)], [(0, None, None)]])
def test_nothing_to_mine(spark, rows):
    assert mined(spark, rows).collect() == []


def test_large_components_stay_exact():
    a = np.array([[2**30 + 1, 3]])
    assert negatives.scores(a, a).tolist() == [[(2**30 + 1) ** 2 + 9]]
    assert negatives.scores(np.array([[3, -5]]), np.array([[7, 2]])).tolist() == [[11]]


def test_clashing_names_and_sql(spark, tmp_path):
    path = "/root/testdata/sf0.01"
    spark.read.parquet(f"{path}/embeddings.parquet").withColumns({c: F.lit("x") for c in ("row", "vector", "group", "score", "rank")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_hard_negatives(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_hard_negatives"]).df()
    order = ["anchor_id", "positive_id", "rank"]
    pd.testing.assert_frame_equal(got[COLUMNS].sort_values(order, ignore_index=True), want[COLUMNS].sort_values(order, ignore_index=True))
