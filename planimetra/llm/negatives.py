"""Hard negatives by a full sort of each anchor's scores.

Vectors become integers, so that scores are exact and ties real. Anchors are taken in chunks of bounded bytes, and each chunk meets all
rows, dealt evenly by a row number: a task scores its block of rows by one matrix product, sorts every anchor's scores by score and id
and keeps the first few of the anchor's label. These meet in a window and give the positives. A second sort reads, for each positive, the
rows of other labels from its upper limit on down to its lower one; the place is found by binary search. A task passes on at most k rows for
each anchor and positive, whatever its block holds, so no task gathers an anchor's whole list.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimetra.llm import arrays
from planimetra.llm.tables import shared_dir, stored

#: A component x becomes floor(SCALE * x).
SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Limits of a negative's score, in percent of the positive's.
LOWER, UPPER = 30, 90
#: Rows of a block and anchors of a chunk: as many as fit the bytes, but no more than these.
BLOCK_ROWS, BLOCK_BYTES = 32_768, 32_000_000
CHUNK_ANCHORS, CHUNK_BYTES = 8_192, 16_000_000
#: Scores in a task's memory at once.
_CELLS = 2_000_000
#: Stands for a missing vec_id: the last among equal scores.
_NO_ID = 2**63 - 1


def prepared(embeddings: DataFrame, label: Column | None = None, scale: float = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label and the integer vector of each row that takes part, stored.

    Rows with a null label, a null vector or a component that is null or not finite take no part. An empty vector has a score of 0 with
    every other; of vectors of different lengths the longer one's rest counts for nothing.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = embeddings.withColumn("label", F.col("label") if label is None else label).filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = kept.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-rows")


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The integer vectors as rows, filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.repeat(np.arange(len(vectors)), sizes), arrays.gathered(np.zeros(len(sizes), np.int64), sizes)] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floats where no sum leaves their 53 bits, else modulo 2**64 as longs."""
    most = float(np.abs(a, dtype=float).max(initial=0)) * float(np.abs(b, dtype=float).max(initial=0)) * max(a.shape[1], 1)
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2.0**53 else a @ b.T


def _best(group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group, highest score and then least id first."""
    order = np.lexsort((vec_id, ~score, group))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) < k]


class Chunk:
    """Anchors with their vectors, and later their positives' limits."""

    def __init__(self, table: pa.Table, width: int):
        self.row, self.vec_id, self.label = (table.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.matrix = _matrix(table.column("vector").combine_chunks(), width)

    def sorted_scores(self, batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor: its place, all scores of the batch's rows, and the order of the rows by score and id."""
        vectors = _matrix(batch.column("vector"), width)
        by_id = np.argsort(batch.column("vec_id").to_numpy(), kind="stable")
        vectors = vectors[by_id]
        step = max(1, _CELLS // max(1, len(vectors)))
        for at in range(0, len(self.row), step):
            part = scores(self.matrix[at : at + step], vectors)
            order = np.argsort(~part, axis=1, kind="stable")  # by id already, so a stable sort by score sorts by both
            for a in range(len(part)):
                yield at + a, part[a][order[a]], by_id[order[a]]


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches joined to blocks of rows at least, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _reader(pick: Callable, k: int, rows: int) -> Callable:
    """Runs pick on each block, and holds the best k of each group while blocks come."""
    schema = pa.schema([(c, pa.int64()) for c in ("group", "score", "vec_id", "row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for block in _blocks(batches, rows):
            held = [np.concatenate([h, n]) for h, n in zip(held, pick(block))]
            best = _best(*held[:3], k)
            held = [h[best] for h in held]
        yield arrays.batch(schema, *held)

    return run


def _fitting(rows: int, size: int, width: int) -> int:
    return max(1, min(rows, size // max(8, 8 * width)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("group").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


_GROUPED = "group long, score long, vec_id long, row long"


def _concatenated(parts: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in zip(*parts)] or [np.zeros(0, np.int64)] * 4


def _mined(rows: DataFrame, chunk: Chunk, width: int, positives: int, negatives: int, lower: int, upper: int) -> DataFrame:
    """anchor and positive as ids and scores, rank and negative, of one chunk of anchors."""
    spark, block = rows.sparkSession, _fitting(BLOCK_ROWS, BLOCK_BYTES, width)
    anchors = spark.sparkContext.broadcast(chunk)

    def same_label(batch: pa.RecordBatch) -> list[np.ndarray]:
        own, out = anchors.value, []
        row, vec_id, label = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        for a, score, order in own.sorted_scores(batch, width):
            found = np.flatnonzero((label[order] == own.label[a]) & (row[order] != own.row[a]))[:positives]
            out.append((np.full(len(found), a), score[found], vec_id[order[found]], row[order[found]]))
        return _concatenated(out)

    best = _ranked(rows.mapInArrow(_reader(same_label, positives, block), _GROUPED), positives).select("group", "score", "vec_id", "row").toArrow()
    anchor, score, vec_id, row = (best.column(c).to_numpy() for c in ("group", "score", "vec_id", "row"))
    order = np.lexsort((row, vec_id, ~score, anchor))
    limits = spark.sparkContext.broadcast((anchor[order], score[order], np.searchsorted(anchor[order], np.arange(len(chunk.row) + 1))))

    def other_labels(batch: pa.RecordBatch) -> list[np.ndarray]:
        own, (_, wanted, first), out = anchors.value, limits.value, []
        row, vec_id, label = (batch.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        for a, score, order in own.sorted_scores(batch, width):
            other = np.flatnonzero(label[order] != own.label[a])
            falling = ~score[other]  # rises where the score falls
            for p in range(first[a], first[a + 1]):
                high, low = int(wanted[p]) * upper // 100, -(int(wanted[p]) * -lower // 100)
                start, end = np.searchsorted(falling, ~np.int64(high)), np.searchsorted(falling, ~np.int64(low), "right")
                found = other[start : min(end, start + negatives)]
                out.append((np.full(len(found), p), score[found], vec_id[order[found]], row[order[found]]))
        return _concatenated(out)

    found = _ranked(rows.mapInArrow(_reader(other_labels, negatives, block), _GROUPED), negatives)
    at = order.tolist()
    pairs = pa.table({"group": pa.array(range(len(at)), pa.int64()), "anchor_id": chunk.vec_id[anchor[at]], "positive_id": vec_id[at], "positive_score": score[at]})
    told = spark.createDataFrame(pairs)  # at most CHUNK_ANCHORS times positives rows
    named = found.join(F.broadcast(told), "group").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    return named.withColumns({c: F.when(F.col(c) != _NO_ID, F.col(c)) for c in ("anchor_id", "positive_id", "negative_id")})


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows come from prepared(). An anchor's positives are the first rows of its label, itself left out, by score and then by least vec_id;
    a positive's negatives are the first rows of other labels whose score lies between lower and upper percent of its own, ends included.
    A positive with a negative score has none. Rows that repeat are rows of their own, as anchors, positives and negatives; a row without a
    vec_id comes last among equal scores and is named null. Without rows, anchors or positives the result is empty. Scores that leave 64 bits wrap.
    """
    spark = rows.sparkSession
    anchors = stored(rows.filter(is_anchor), "negatives-anchors")
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    chunks = -(-anchors.count() // _fitting(CHUNK_ANCHORS, CHUNK_BYTES, width))
    dealt = stored(rows.repartition(max(1, -(-n // _fitting(BLOCK_ROWS, BLOCK_BYTES, width))), "row"), "negatives-blocks")
    path = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for c in range(chunks):
        own = anchors.filter(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).orderBy("vec_id", "row").toArrow()
        if own.num_rows:
            _mined(dealt, Chunk(own, width), width, positives, negatives, lower, upper).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
