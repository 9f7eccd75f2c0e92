"""Text quality by kernel ridge regression on document statistics.

Each text becomes a row of numbers: its length, the kinds of its characters, the shape of its words and lines, and how much it repeats. Random
Fourier features of these approximate a Gaussian kernel. Each partition of labelled rows adds up its share of the normal equations, the shares
are added row by row of the matrix, and the ridge solution is found on the driver, whose work depends on the number of features alone. An
isotonic curve, fitted on labelled rows that the regression has not seen, turns the regression's value into a share of good texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimetra.llm import arrays
from planimetra.llm.tables import keyed, public_id, stored

#: Random features, their seed, and the ridge in rows.
FEATURES, SEED, RIDGE = 256, 12, 1.0
#: A statistic counts for no more than so many standard deviations.
FARTHEST = 4.0
THRESHOLD = 0.7

STATISTICS = (
    "log_bytes", "log_words", "word_mean", "word_spread", "distinct_words", "distinct_pairs", "top_word", "capitals", "digits", "spaces", "stops", "other_marks", "beyond_ascii",
    "letter_ends", "capital_starts", "stop_ends", "words_per_line", "distinct_lines", "entropy",
)
_CLASSES = np.zeros(256, np.uint8)
for _k, _bytes in enumerate((range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32), b".,;:!?'\"()-", [*range(33, 127)], range(128, 256)), 1):
    for _b in _bytes:
        _CLASSES[_b] = _CLASSES[_b] or _k
_CLASSES[97:123] = 0  # small letters are what is left


def _shares_of_distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct values, and how often the commonest occurs."""
    texts = len(first) - 1
    if not len(values):
        return np.zeros(texts), np.zeros(texts)
    owner = arrays.owners(first)
    order = np.lexsort((values, owner))
    new = np.flatnonzero(np.r_[True, (np.diff(owner[order]) > 0) | (values[order][1:] != values[order][:-1])])
    of, n = owner[order][new], np.diff(new, append=len(values))
    most = np.zeros(texts)
    np.maximum.at(most, of, n)
    return np.bincount(of, minlength=texts).astype(float), most


def statistics(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """STATISTICS of each whole text, as rows; all are 0 of an empty one."""
    texts, size = len(starts) - 1, np.diff(starts).astype(float)
    owner = arrays.owners(starts)
    begin, end, first = arrays.word_bounds(data, starts)
    words = np.diff(first).astype(float)
    per = lambda total, n: total / np.maximum(n, 1)
    kinds = np.bincount(owner * 7 + _CLASSES[data], minlength=texts * 7).reshape(texts, 7)
    length = (end - begin).astype(float)
    of_word = arrays.owners(first)
    summed = lambda x: np.bincount(of_word, weights=x, minlength=texts)
    hashes = arrays.word_hashes(data, begin, end)
    distinct, most = _shares_of_distinct(hashes, first)
    follows = np.ones(len(begin), bool)
    follows[first[:-1][first[:-1] < len(begin)]] = False
    pairs = np.flatnonzero(follows)
    distinct_pairs, _ = _shares_of_distinct(arrays.mixed(hashes[pairs] + arrays.mixed(hashes[pairs - 1])), np.searchsorted(pairs, first))
    last, head = _CLASSES[data[end - 1]], _CLASSES[data[begin]]
    # lines, the last of a text with or without its own end
    breaks = np.flatnonzero(data == 10)
    to = np.union1d(breaks, starts[1:][size > 0])
    line_starts = np.union1d(np.r_[breaks + 1], starts[:-1][size > 0])
    line_starts = line_starts[line_starts < len(data)]
    line_ends = to[np.searchsorted(to, line_starts)]
    lines = np.searchsorted(line_starts, starts)
    distinct_lines, _ = _shares_of_distinct(arrays.word_hashes(data, line_starts, line_ends), lines)
    n_lines = np.diff(lines).astype(float)
    share = np.bincount(owner * 256 + data, minlength=texts * 256).reshape(texts, 256) / np.maximum(size, 1)[:, None]
    mean = per(summed(length), words)
    out = np.column_stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(per(summed(length**2), words) - mean**2, 0)), per(distinct, words), per(distinct_pairs, np.maximum(words - 1, 0)), per(np.maximum(most - 1, 0), words),
        *(per(kinds[:, k], size) for k in (1, 2, 3, 4, 5, 6)),
        per(summed((last == 0) | (last == 1) | (last == 6)), words), per(summed(head == 1), words), per(summed(last == 4), words),
        np.log1p(per(words, n_lines)), per(distinct_lines, n_lines), -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1),
    ])
    return np.where(size[:, None] > 0, out, 0.0)


def described(documents: DataFrame) -> DataFrame:
    """doc_id, row_key and x, the statistics of the whole text, stored."""
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in arrays.chunks(batches):
            x = statistics(data, starts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield arrays.batch(schema, rows.column("doc_id"), rows.column("row_key"), lists)

    return stored(keyed(documents).mapInArrow(run, "doc_id long, row_key long, x array<double>"), "quality-statistics")


def _rows_of(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Kernel:
    """Standardised statistics and their random Fourier features."""

    mean: np.ndarray
    spread: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Features of rows of statistics; their inner products are near exp(-d**2 / (2 * s**2)), with s**2 the number of statistics."""
        z = np.clip((x - self.mean) / self.spread, -FARTHEST, FARTHEST)
        rng = np.random.default_rng(SEED)
        direction = rng.normal(size=(len(self.mean), FEATURES)) / np.sqrt(len(self.mean))
        return np.sqrt(2 / FEATURES) * np.cos(z @ direction + rng.uniform(0, 2 * np.pi, FEATURES))


def normal_equations(rows: DataFrame, kernel: Kernel) -> np.ndarray:
    """The sum of outer products of (features, 1, y) over rows with x and y.

    A partition passes on one matrix, as rows with their number; these are added in the order of partitions, so that reruns agree.
    """
    size = FEATURES + 2
    shape = "part int, i int, v array<double>"
    schema = pa.schema([("part", pa.int32()), ("i", pa.int32()), ("v", pa.list_(pa.float64()))])

    def block(part: int, i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * size, pa.int32()), pa.array(v.ravel()))
        return arrays.batch(schema, np.full(len(i), part), i, lists)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((size, size)), False
        for batch in batches:
            if batch.num_rows:
                z = np.column_stack([kernel(_rows_of(batch.column("x"))), np.ones(batch.num_rows), batch.column("y").to_numpy(zero_copy_only=False)])
                total, seen = total + z.T @ z, True
        if seen:
            yield block(TaskContext.get().partitionId(), np.arange(size), total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), _rows_of(batch.column("v")) if batch.num_rows else ()):
                total[i] = total[i] + v if i in total else v
        if total:
            yield block(0, np.array(list(total)), np.array(list(total.values())))

    shares = rows.select("x", "y").mapInArrow(partial, shape)
    sums = shares.repartition("i").sortWithinPartitions("i", "part").mapInArrow(added, shape).select("i", "v").toArrow()
    out = np.zeros((size, size))
    if sums.num_rows:
        out[sums.column("i").to_numpy()] = _rows_of(sums.column("v").combine_chunks())
    return out


def solved(sums: np.ndarray) -> np.ndarray:
    """Ridge weights of the features and the constant, which is not held back."""
    a, b = sums[:-1, :-1], sums[:-1, -1]
    penalty = np.full(len(a), RIDGE)
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    #: Knots of the isotonic curve: values of the regression and their scores.
    values: np.ndarray
    scores: np.ndarray

    def regressed(self, rows: DataFrame) -> DataFrame:
        """rows with value, the regression's; all other columns but x stay."""
        kernel, weights = self.kernel, self.weights
        kept = [c for c in rows.columns if c != "x"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = kernel(_rows_of(batch.column("x"))) @ weights[:-1] + weights[-1] if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(value)], names=[*kept, "value"])

        return rows.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", value double")


def fold() -> Column:
    """The remainder that decides what a row is for: 2 is held out, 3 calibrates, the others are learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def fit(rows: DataFrame, labels: DataFrame) -> Model | float:
    """The model of labelled rows (doc_id, row_key, x); the one class's score if all labels agree, 0 if there are none."""
    known = labels.filter("doc_id is not null and quality in (0, 1)").filter(fold() != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("y"))
    learnt = stored(rows.join(stored(known, "quality-labels"), "doc_id").select("doc_id", "row_key", "x", "y"), "quality-learnt")
    least, most, n = learnt.agg(F.min("y"), F.max("y"), F.count_if(fold() != 3)).first()
    if least is None or least == most:
        return least or 0.0
    own = learnt.filter(fold() != 3) if n else learnt
    at = range(len(STATISTICS))
    moments = own.agg(*(F.avg(F.col("x")[i]) for i in at), *(F.stddev_pop(F.col("x")[i]) for i in at)).first()
    mean, spread = np.array(moments[: len(at)]), np.array(moments[len(at) :])
    kernel = Kernel(mean, np.where(spread > 1e-12, spread, 1.0))
    model = Model(kernel, solved(normal_equations(own, kernel)), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    calibration = model.regressed(learnt.filter(fold() == 3)).select("value", "y")
    if not calibration.isEmpty():
        curve = IsotonicRegression(featuresCol="value", labelCol="y").fit(calibration)
        model.values, model.scores = curve.boundaries.toArray(), curve.predictions.toArray()
    return model


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of documents.

    Only doc_id and quality of labels, text and doc_id of documents are read, and labels of held-out rows never. A null text is an empty one,
    whose statistics are all 0. A null doc_id is held out. A doc_id with several labels is good if one of them says so; other values than 0 and 1
    count for nothing. Without labels of both classes every score is that of the class there is, 0 if there is none.
    """
    rows = described(documents)
    model = fit(rows, labels)
    if isinstance(model, float):
        scored = rows.withColumn("score", F.lit(model))
    else:
        values, scores = model.values, model.scores
        knots = documents.sparkSession.sparkContext.broadcast((values, scores))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score = np.clip(np.interp(batch.column("value").to_numpy(), *knots.value), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

        scored = model.regressed(rows).mapInArrow(run, "doc_id long, score double")
    scored = scored.withColumn("doc_id", public_id())
    return scored.select("doc_id", F.coalesce(fold() == 2, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
