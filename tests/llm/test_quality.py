import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from planimetra.llm import arrays, quality
from tests.llm.fixtures import awkward, documents

SF = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def plain(text: str) -> list[float]:
    """The statistics of one text, one by one."""
    data = text.encode()
    if not data:
        return [0.0] * len(quality.STATISTICS)
    words, lines, n = re.findall(rb"[^\x20\x09-\x0D]+", data), data.split(b"\n"), len(data)
    if lines[-1] == b"":
        lines.pop()
    w, stops = max(len(words), 1), b".,;:!?'\"()-"
    lengths = [len(x) for x in words]
    mean = sum(lengths) / w
    share = lambda test: sum(map(test, data)) / n
    pairs = list(zip(words, words[1:]))
    small, capital, space = (lambda b: 97 <= b < 123), (lambda b: 65 <= b < 91), (lambda b: b in b" \t\n\x0b\x0c\r")
    mark = lambda b: 33 <= b < 127 and not (small(b) or capital(b) or 48 <= b < 58 or b in stops)
    letter = lambda b: small(b) or capital(b) or b >= 128 or (b < 32 and not space(b)) or b == 127
    return [
        math.log1p(n), math.log1p(len(words)), mean, math.sqrt(max(sum(x * x for x in lengths) / w - mean**2, 0)), len(set(words)) / w, len(set(pairs)) / max(len(words) - 1, 1),
        max(max(Counter(words).values(), default=0) - 1, 0) / w, share(capital), share(lambda b: 48 <= b < 58), share(space), share(lambda b: b in stops), share(mark), share(lambda b: b >= 128),
        sum(letter(x[-1]) for x in words) / w, sum(capital(x[0]) for x in words) / w, sum(x[-1] in stops for x in words) / w,
        math.log1p(len(words) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), -sum(c / n * math.log2(c / n) for c in Counter(data).values()),
    ]


def test_statistics_equal_plain_ones():
    texts = [t or "" for _, t in awkward()] + ["A b.\nA b.\n\nC-d 12 #x é!", "\n\n", "a\n", "Ünï cödé", "x y x y x"]
    data, starts = arrays.flat_bytes(pa.array(texts))
    np.testing.assert_allclose(quality.statistics(data, starts), [plain(t) for t in texts], atol=1e-9)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 19))
    z = quality.Kernel(np.zeros(19), np.ones(19))(x)
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 19))
    assert np.abs(z @ z.T - exact).max() < 0.25 and np.abs(z @ z.T - exact).mean() < 0.05


def test_partition_sums_equal_one_sum(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 19)), rng.integers(0, 2, 500)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double")
    kernel = quality.Kernel(np.zeros(19), np.ones(19))
    z = np.column_stack([kernel(x), np.ones(500), y])
    for parts in (1, 7):
        np.testing.assert_allclose(quality.normal_equations(rows.repartition(parts), kernel), z.T @ z, atol=1e-8)
    w = quality.solved(z.T @ z)
    gradient = z[:, :-1].T @ (z[:, :-1] @ w - y) + quality.RIDGE * np.r_[w[:-1], 0]
    assert np.abs(gradient).max() < 1e-6


def test_held_out_quality(spark):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.score(table, labels).collect()}
    assert len(rows) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = ([r.predicted for r, q in held if q == k] for k in (1, 0))
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.05
    again = {r.doc_id: r.score for r in quality.score(table.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[d] - r.score) < 1e-6 for d, r in rows.items())


def test_reads_only_text_and_labels_outside_the_fold(spark):
    table, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(3000).cache(), spark.read.parquet(f"{SF}/labels.parquet")
    plain_scores = {r.doc_id: r.score for r in quality.score(table, labels).collect()}
    other = labels.withColumn("quality", F.when(quality.fold() == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = table.withColumns({"lang": F.lit("xx"), "source": F.lit("same"), "n_chars": F.lit(1)})
    assert {r.doc_id: r.score for r in quality.score(changed, other).collect()} == plain_scores


def test_awkward_rows_and_labels(spark):
    table = documents(spark).withColumns({"x": F.lit(1), "y": F.lit(2), "value": F.lit("v"), "score": F.lit(1)})
    n = table.count()
    free = [d for d in range(17) if zlib.crc32(str(d).encode()) % 4 != 2]
    for labels, score in (([], 0.0), ([(free[0], 1, 0), (free[1], 1, 0), (None, 0, 0)], 1.0), ([(free[2], 0, 1), (free[3], None, 1), (free[4], 7, 1)], 0.0)):
        got = quality.score(table, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == n and {r.score for r in got} == {score} and {r.held_out for r in got if r.doc_id is None} == {True}
    mixed = [(d, d % 2, 0) for d in range(17)] + [(3, 0, 0), (3, 1, 1)]
    only_calibration = [(d, i % 2, 0) for i, d in enumerate(d for d in range(17) if zlib.crc32(str(d).encode()) % 4 == 3)]
    for labels in (mixed, only_calibration):
        got = quality.score(table, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == n and all(0 <= r.score <= 1 for r in got)
    assert quality.score(documents(spark, []), spark.createDataFrame(mixed, LABELS)).count() == 0
