"""Interaction of document filters: who removes what under every order of application.

A document's failures are a bit mask. A table with one row for each mask and one column for each order holds the step at which the
first failing filter stands; it answers all orders of a batch by one index. Tasks add up their parts' counts by np.bincount and pass
on one array of counts for each part, and Spark adds these. What leaves a task grows with the number of parts, not of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planimetra.llm import arrays
from planimetra.llm.tables import stored

#: Least words, least percent of distinct words, most percent of capitals, and characters of markup or tables.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, "[#$%&*|]"
FILTERS = "ABCDE"
#: A task passes its counts on when it has met so many parts, and begins anew.
PARTS_HELD = 256

_SPLIT = r"[\x20\x09-\x0D]+"
_COUNTS = ("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "total")
_SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _COUNTS)])


def failures(documents: DataFrame) -> DataFrame:
    """doc_id, part (source, '' for null) and mask of each row: bit i is set if the document fails filter FILTERS[i].

    A: too few words, B: too few distinct words, C: too many capitals, D: symbols, E: the text of a document with a smaller doc_id. A
    null text is the empty one. Of rows that repeat a doc_id and its text none is a copy of the other; a row without a doc_id is no copy
    and has none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("text", _SPLIT), lambda w: w != "")
    n = F.size("words")
    bits = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n,
        100 * F.regexp_count("text", F.lit("[A-Z]")) > MOST_CAPITALS * F.char_length("text"),
        F.col("text").rlike(SYMBOLS),
    ]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    own = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    judged = stored(rows.withColumn("words", words).select("doc_id", "part", own.alias("mask"), F.unhex(F.sha2("text", 256)).alias("content")), "audit-documents")
    # written before the join, so that a text with very many copies is split over tasks there
    firsts = stored(judged.groupBy("content").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "audit-firsts")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return judged.join(firsts, "content", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(bits)).otherwise(0)).alias("mask"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good (quality = 1) and toxic (toxic = 1); of several labels of a doc_id one is enough, without any both are false."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    return rows.drop("good", "toxic").join(stored(known, "audit-labels"), "doc_id", "left").na.fill(False, ["good", "toxic"])


class Orders:
    """All orders of n filters: at[mask, order] is the step of the first failure (n: none), filter[order, step] the filter that stands there."""

    def __init__(self, n: int):
        self.n = n
        self.filter = np.array(list(permutations(range(n))), np.int64)
        fails = (np.arange(1 << n)[:, None, None] >> self.filter[None]) & 1
        self.at = np.where(fails.any(axis=2), fails.argmax(axis=2), n)
        self.late = (fails == 1) & (self.at[:, :, None] < np.arange(n))
        self.alone = (1 << self.filter)[None] == np.arange(1 << n)[:, None, None]

    def counts(self, part: np.ndarray, parts: int, mask: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """_COUNTS for each part, order and step, of documents with these parts, masks and labels."""
        kinds, place = np.unique(part * (1 << self.n) + mask, return_inverse=True)
        weights = [np.bincount(place, weights=w, minlength=len(kinds)) for w in (np.ones(len(place)), good, toxic)]
        part, mask = kinds >> self.n, kinds & ((1 << self.n) - 1)
        orders = len(self.filter)
        cell = ((part[:, None] * orders + np.arange(orders)) * (self.n + 1) + self.at[mask]).ravel()
        size = parts * orders * (self.n + 1)
        removed, good_lost, toxic_lost = (np.bincount(cell, weights=np.repeat(w, orders), minlength=size).reshape(parts, orders, -1)[:, :, :-1] for w in weights)
        out = np.zeros((len(_COUNTS), parts, orders, self.n))
        out[0], out[3], out[4] = removed, good_lost, toxic_lost
        for k, table in ((1, self.late), (2, self.alone)):
            np.add.at(out[k], part, table[mask] * weights[0][:, None, None])
        out[5] += np.bincount(part, weights=weights[0], minlength=parts)[:, None, None]
        return out.astype(np.int64)


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, filter_order (a permutation of the letters of filters) and step, zeros included.

    rows: part, mask, good, toxic; a null part is '', a null label false, and a null mask is a document that fails nothing. Counts within
    the part: kept after the step, removed by its filter, redundant (failed the filter, but removed before), unique_fails (failed this
    filter only), good_lost and toxic_lost of the removed, shapley (removed by this filter in all orders together). No rows, no parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(len(filters))
        names = ["".join(filters[f] for f in order) for order in orders.filter.tolist()]
        step = np.tile(np.arange(1, orders.n + 1, dtype=np.int32), len(names))
        held: dict[str, np.ndarray] = {}

        def emitted() -> Iterator[pa.RecordBatch]:
            for part, counts in held.items():
                yield arrays.batch(_SCHEMA, [part] * len(step), [n for n in names for _ in range(orders.n)], step, *counts.reshape(len(_COUNTS), -1))
            held.clear()

        for batch in batches:
            part = batch.column("part").dictionary_encode()
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mask", "good", "toxic")]
            for name, counts in zip(part.dictionary.to_pylist(), orders.counts(part.indices.to_numpy().astype(np.int64), len(part.dictionary), *values).transpose(1, 0, 2, 3)):
                held[name] = held[name] + counts if name in held else counts
            if len(held) >= PARTS_HELD:
                yield from emitted()
        yield from emitted()

    ready = rows.select(F.coalesce("part", F.lit("")).alias("part"), *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in ("mask", "good", "toxic")))
    partial = ready.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))
    summed = stored(partial.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in _COUNTS)), "audit-sums")
    so_far = Window.partitionBy("part", "filter_order").orderBy("step")
    every_order = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return summed.select(
        "part", "filter_order", "step", (F.col("total") - F.sum("removed").over(so_far)).alias("kept"), "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        F.sum("removed").over(every_order).alias("shapley"),
    )
