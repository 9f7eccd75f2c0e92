"""Toxicity by class-conditional Kneser-Ney language models.

Two word bigram models, of toxic and of ordinary labelled texts, back off to their own continuation counts (after how many
different words a word was seen in texts of the class), and those to continuation counts that both classes share. All pairs
of neighbours in all labelled rows are counted, under 64-bit keys, in Spark tables. A text's features are its mean
log-likelihood ratio per word under the bigram models, and the largest ratio of a single word under the lower order, since one
expression can make a text toxic; a logistic curve, fitted on rows that gave no counts, turns them into a score.

The discount is one count: a pair or a continuation that was seen once is chance and backs off wholly. So the tables that scoring
needs hold only what was seen twice at least in a class, and nothing is left out of the counts for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimetra.llm import arrays
from planimetra.llm.tables import keyed, public_id, stored

#: A history's own pairs count against this many words of the lower order, in both classes.
PRIOR = 50
#: No word says more than this for or against a class.
LARGEST_RATIO = 5.0
#: The calibration curve is fitted on about this many labelled rows at most; counts take all rows.
CALIBRATION_ROWS = 20_000
#: Labels are broadcast to the texts up to this many rows (16 bytes each), and joined by a shuffle beyond.
BROADCAST_LABELS = 1_000_000
#: The model's tables are broadcast up to this many rows in all (16 bytes each). Beyond, pairs are broadcast in blocks of so many rows, each for one more
#: pass over the texts; only if the other tables have more rows are all joined to the texts' words, which are many times the texts on disk.
BROADCAST_MODEL = 4_000_000

_U = np.uint64
_TABLE = arrays.letters_table()
#: Stands before the first word of a text.
_START = _U(1)


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, of the one before, of both, and each text's first word."""
    data = arrays.lower_ascii(data)
    begin, end, first = arrays.word_bounds(data, starts, _TABLE)
    word = arrays.word_hashes(data, begin, end)
    before = np.full(len(word), _START)
    before[1:] = word[:-1]
    before[first[:-1][first[:-1] < len(word)]] = _START
    return word, before, _pair(before, word), first


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return arrays.mixed(word + arrays.mixed(before))


_PAIR = "before long, word long, ordinary long, toxic long"
_PAIR_ARROW = pa.schema([(c, pa.int64()) for c in ("before", "word", "ordinary", "toxic")])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbours of a chunk of texts, counted by class."""
    for rows, data, starts in arrays.chunks(batches):
        word, before, pair, first = tokens(data, starts)
        if len(word):
            label = np.repeat(rows.column("toxic").to_numpy(), np.diff(first))
            kinds, at, place = np.unique(pair, return_index=True, return_inverse=True)
            toxic = np.bincount(place, weights=label, minlength=len(kinds)).astype(np.int64)
            yield arrays.batch(_PAIR_ARROW, arrays.signed(before[at]), arrays.signed(word[at]), np.bincount(place, minlength=len(kinds)) - toxic, toxic)


@dataclass
class Tables:
    """What scoring looks up: log ratios of words, what a history adds to them, and ratios of pairs; unseen: of other words."""

    words: DataFrame
    histories: DataFrame
    pairs: DataFrame
    unseen: float
    _shared: Broadcast | None = None
    _in_turn: tuple[Broadcast, list[Broadcast]] | None = None

    @classmethod
    def of(cls, counted: DataFrame) -> Tables:
        """counted: before, word, ordinary, toxic."""
        kinds = lambda c: F.count_if(F.col(c) > 0)
        words = stored(counted.groupBy("word").agg(kinds("ordinary").alias("n0"), kinds("toxic").alias("n1"), F.count(F.lit(1)).alias("n")), "continuations")
        t = words.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1", "n")], F.count(F.lit(1)).alias("words"), kinds("n0").alias("kinds0"), kinds("n1").alias("kinds1")).first()
        shared = (F.col("n") + 0.5) / (t.n + 0.5 * t.words + 0.5)

        def lower(k: int) -> Column:
            total, seen = (t.n0, t.kinds0) if k == 0 else (t.n1, t.kinds1)
            return (F.greatest(F.col(f"n{k}") - 1, F.lit(0)) + seen * shared) / total if total else shared

        unseen = np.log((t.kinds1 or 1) / (t.n1 or 1)) - np.log((t.kinds0 or 1) / (t.n0 or 1))
        levels = words.select("word", lower(0).alias("low0"), lower(1).alias("low1"), (F.greatest("n0", "n1") > 1).alias("told"))
        histories = counted.groupBy("before").agg(F.sum("ordinary").alias("c0"), F.sum("toxic").alias("c1"), kinds("ordinary").alias("k0"), kinds("toxic").alias("k1")).filter("c0 > k0 or c1 > k1")
        histories = stored(histories, "histories")
        left = lambda k: (F.col(f"k{k}") + PRIOR) / (F.col(f"c{k}") + PRIOR)
        repeated = counted.filter("ordinary > 1 or toxic > 1").join(levels, "word").join(histories, "before")
        own = lambda k, c: F.greatest(F.col(c) - 1, F.lit(0)) / (F.col(f"c{k}") + PRIOR) + left(k) * F.col(f"low{k}")
        return cls(
            stored(levels.filter("told").select("word", (F.log("low1") - F.log("low0")).alias("ratio")), "word-ratios"),
            stored(histories.select("before", (F.log(left(1)) - F.log(left(0))).alias("adds")), "history-ratios"),
            stored(repeated.select("before", "word", (F.log(own(1, "toxic")) - F.log(own(0, "ordinary"))).alias("pair_ratio")), "pair-ratios"),
            float(unseen),
        )

    def features(self, rows: DataFrame) -> DataFrame:
        """doc_id, row_key, toxic of rows with mean and peak; both are 0 without words. rows have text too."""
        known, pairs = self.words.count() + self.histories.count(), self.pairs.count()
        if known + pairs <= BROADCAST_MODEL:
            return self._looked_up(rows)
        return self._in_blocks(rows, -(-pairs // BROADCAST_MODEL)) if known <= BROADCAST_MODEL else self._joined(rows)

    def _looked_up(self, rows: DataFrame) -> DataFrame:
        if self._shared is None:
            self._shared = rows.sparkSession.sparkContext.broadcast([_Sorted.of(t) for t in (self.words, self.histories, self.pairs)])
        shared, unseen = self._shared, self.unseen
        schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("toxic", pa.int32()), ("mean", pa.float64()), ("peak", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, histories, pairs = shared.value
            for own, data, starts in arrays.chunks(batches):
                word, before, pair, first = tokens(data, starts)
                alone = words(word, unseen)
                both = pairs(pair, alone + histories(before, 0.0))
                n = np.diff(first)
                x = np.zeros((2, len(n)))
                full = np.flatnonzero(n)
                if len(full):
                    at = first[:-1][full]
                    x[0, full] = np.add.reduceat(np.clip(both, -LARGEST_RATIO, LARGEST_RATIO), at) / n[full]
                    x[1, full] = np.maximum.reduceat(np.clip(alone, -LARGEST_RATIO, LARGEST_RATIO), at)
                yield arrays.batch(schema, own.column("doc_id"), own.column("row_key"), own.column("toxic"), x[0], x[1])

        return rows.select("doc_id", "row_key", "toxic", "text").mapInArrow(run, "doc_id long, row_key long, toxic int, mean double, peak double")

    def _in_blocks(self, rows: DataFrame, n: int) -> DataFrame:
        """The same in n passes over the texts, each for the words whose pair would be in its block: nothing but sums is shuffled."""
        context, unseen = rows.sparkSession.sparkContext, self.unseen
        if self._in_turn is None:
            block = F.pmod(F.col("before").bitwiseXOR(F.col("word")), F.lit(n))
            self._in_turn = context.broadcast([_Sorted.of(t) for t in (self.words, self.histories)]), [context.broadcast(_Sorted.of(self.pairs.filter(block == k))) for k in range(n)]
        (shared, blocks), texts = self._in_turn, rows.select("row_key", "text")
        schema = pa.schema([("row_key", pa.int64()), ("block", pa.int32()), ("n", pa.int64()), ("total", pa.float64()), ("peak", pa.float64())])

        def passed(block: int, held: Broadcast):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                words, histories = shared.value
                for own, data, starts in arrays.chunks(batches):
                    word, before, pair, first = tokens(data, starts)
                    some = np.flatnonzero((before ^ word).view(np.int64) % n == block)
                    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[some]
                    alone = words(word[some], unseen)
                    both = held.value(pair[some], alone + histories(before[some], 0.0))
                    total = np.bincount(row, np.clip(both, -LARGEST_RATIO, LARGEST_RATIO), len(first) - 1)
                    peak = np.full(len(first) - 1, -np.inf)
                    np.maximum.at(peak, row, np.clip(alone, -LARGEST_RATIO, LARGEST_RATIO))
                    there = np.bincount(row, minlength=len(first) - 1)
                    full = np.flatnonzero(there)
                    yield arrays.batch(schema, own.column("row_key").take(pa.array(full)), np.full(len(full), block), there[full], total[full], peak[full])

            return texts.mapInArrow(run, "row_key long, block int, n long, total double, peak double")

        found = None
        for k, held in enumerate(blocks):
            found = passed(k, held) if found is None else found.unionByName(passed(k, held))
        # rows that repeat id and text have one key and equal sums; sums are added in the order of the blocks
        once = found.groupBy("row_key", "block").agg(*[F.first(c).alias(c) for c in ("n", "total", "peak")])
        told = once.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("block", "total"))).alias("_t"), F.sum("n").alias("_n"), F.max("peak").alias("peak"))
        mean = F.aggregate("_t", F.lit(0.0), lambda x, y: x + y["total"]) / F.col("_n")
        return rows.select("doc_id", "row_key", "toxic").join(told.select("row_key", mean.alias("mean"), "peak"), "row_key", "left").na.fill(0.0, ["mean", "peak"])

    def _joined(self, rows: DataFrame) -> DataFrame:
        """The same by joins, for tables of any size."""
        schema = pa.schema([("row_key", pa.int64()), ("before", pa.int64()), ("word", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own, data, starts in arrays.chunks(batches):
                word, before, pair, first = tokens(data, starts)
                if len(word):
                    row = np.repeat(own.column("row_key").to_numpy(), np.diff(first))
                    _, at, n = np.unique(arrays.mixed(pair + arrays.mixed(row.view(_U))), return_index=True, return_counts=True)
                    yield arrays.batch(schema, row[at], *(arrays.signed(x[at]) for x in (before, word)), n)

        found = rows.dropDuplicates(["row_key"]).select("row_key", "text").mapInArrow(run, "row_key long, before long, word long, n long")
        found = found.join(self.words, "word", "left").join(self.histories, "before", "left").join(self.pairs, ["before", "word"], "left")
        clipped = lambda x: F.greatest(F.lit(-LARGEST_RATIO), F.least(F.lit(LARGEST_RATIO), x))
        alone = F.coalesce("ratio", F.lit(self.unseen))
        both = F.coalesce("pair_ratio", alone + F.coalesce("adds", F.lit(0.0)))
        told = found.groupBy("row_key").agg((F.sum(clipped(both) * F.col("n")) / F.sum("n")).alias("mean"), F.max(clipped(alone)).alias("peak"))
        return rows.select("doc_id", "row_key", "toxic").join(told, "row_key", "left").na.fill(0.0, ["mean", "peak"])


@dataclass
class _Sorted:
    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, table: DataFrame) -> _Sorted:
        arrow = table.toArrow()
        *keys, values = (c.to_numpy() for c in arrow.columns)
        key = keys[0].view(_U) if len(keys) == 1 else _pair(*(k.view(_U) for k in keys))
        order = np.argsort(key)
        return cls(key[order], values[order])

    def __call__(self, keys: np.ndarray, otherwise: np.ndarray | float) -> np.ndarray:
        """Values of keys, and otherwise for those that are not there."""
        out = np.broadcast_to(np.asarray(otherwise, float), keys.shape).copy()
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
            out[known] = self.values[at[known]]
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (constant first) by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        penalty = np.diag([0.0] + [ridge] * (z.shape[1] - 1)) + 1e-9 * np.eye(z.shape[1])
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))


@dataclass
class Model:
    tables: Tables
    curve: np.ndarray

    def score(self, rows: DataFrame) -> DataFrame:
        constant, mean, peak = map(float, self.curve)
        value = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(constant) + mean * F.col("mean") + peak * F.col("peak")))
        return self.tables.features(rows).withColumn("score", 1 / (1 + F.exp(-value)))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Counts of folds 2 to 4, a curve fitted on fold 1. A doc_id that labels call toxic at least once is."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(fold() != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = keyed(documents).join(known, "doc_id")
    counted = rows.filter(fold() > 1).select("text", "toxic").mapInArrow(_counted, _PAIR)
    tables = Tables.of(stored(counted.groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "word-pairs"))
    calibration = rows.filter(fold() == 1)
    n = known.filter(fold() == 1).count()
    if n > CALIBRATION_ROWS:
        calibration = calibration.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * CALIBRATION_ROWS / n))
    seen = tables.features(calibration).select("mean", "peak", "toxic").toArrow()
    x, y = np.column_stack([seen.column("mean").to_numpy(), seen.column("peak").to_numpy()]), seen.column("toxic").to_numpy()
    if 0 < y.sum() < len(y):
        order = np.lexsort((y, x[:, 1], x[:, 0]))  # sums must not depend on the order of rows
        return Model(tables, logistic(x[order], y[order].astype(float)))
    return Model(tables, np.array([-30.0 if not y.sum() else 30.0, 0.0, 0.0]))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of documents.

    Only doc_id and toxic of labels, text and doc_id of documents are read; labels of held-out rows never. A null text
    has no words and gets the score of an empty one. A null doc_id is held out. Without labels of both classes every score
    is that of the class there is, 0 if there is none.
    """
    model = fit(documents, labels)
    scored = model.score(keyed(documents).withColumn("toxic", F.lit(None).cast("int"))).withColumn("doc_id", public_id())
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
