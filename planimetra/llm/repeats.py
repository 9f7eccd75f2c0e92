"""Where texts repeat: anchored contexts of fixed-length windows, shared by the substring and suffix-array operators.

A window is W consecutive units (words or bytes) of one text. The gram with the least hash inside a window is its
anchor; equal windows have equal anchors, wherever they stand. Neighbouring windows with the same anchor form a
context. Contexts are small, so a shuffle moves only their hashes; the contents of those that share an anchor with
another context are fetched later. This keeps a key small and needs no list of all windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.llm import arrays
from planimetra.llm.tables import stored

_U = np.uint64
_POSITION_BITS = 22
#: Anchors with more distinct contexts than this are split: each of their windows becomes a key of its own.
HOT_CONTEXTS = 768

_OCCURRENCE = "doc_id long, row_key long, anchor long, context long, start int, windows int"
_OCCURRENCE_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("anchor", pa.int64()), ("context", pa.int64()), ("start", pa.int32()), ("windows", pa.int32())])
_CONTENT = "doc_id long, row_key long, anchor long, context long, start int, windows int, content binary"
_CONTENT_ARROW = pa.schema([*_OCCURRENCE_ARROW, ("content", pa.binary())])
_WINDOW = "doc_id long, row_key long, window long, start int"
_WINDOW_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("window", pa.int64()), ("start", pa.int32())])
_SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32()), ("size", pa.int32())])
SPAN = "doc_id long, row_key long, start int, size int"


@dataclass(frozen=True)
class Unit:
    """What a window is made of. values: flat 64-bit values and the first of each text."""

    window: int
    gram: int
    values: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    content: np.dtype


def word_values(data, starts):
    begin, end, first = arrays.word_bounds(data, starts)
    return arrays.word_hashes(data, begin, end), first


def byte_values(data, starts):
    return arrays.byte_values(data), starts


def contexts_of(values: np.ndarray, first: np.ndarray, window: int, gram: int, most: int = (1 << _POSITION_BITS) - 1):
    """Owner text, anchor hash, context hash, start within the text, and number of windows of each context."""
    empty = np.zeros(0, np.int64)
    if len(values) < window:
        return empty, empty.view(_U), empty.view(_U), empty, empty
    hashes = arrays.RangeHash(values)
    grams = hashes.grams(gram)
    low = _U((1 << _POSITION_BITS) - 1)
    if len(grams) > most:  # one text of many millions of units: ranks take the place of hash and position
        order = np.argsort(grams & ~low, kind="stable")
        packed = np.empty(len(grams), _U)
        packed[order] = np.arange(len(grams), dtype=_U)
        least = order[arrays.sliding_min(packed, window - gram + 1)]
    else:
        packed = (grams & ~low) | np.arange(len(grams), dtype=_U)
        least = (arrays.sliding_min(packed, window - gram + 1) & low).astype(np.int64)
    owner = arrays.owners(first)
    usable = owner[: len(least)] == owner[window - 1 : window - 1 + len(least)]
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | ~usable[:-1]
    begin = np.flatnonzero(usable & fresh)
    stop = np.ones(len(least), bool)
    stop[:-1] = fresh[1:] | ~usable[1:]
    end = np.flatnonzero(usable & stop)
    at = least[begin]
    content = hashes(begin, end + window)
    count = end - begin + 1
    context = arrays.mixed(content ^ arrays.mixed((at - begin).astype(_U) * _U(0x10001) + count.astype(_U)))
    text = owner[begin]
    return text, grams[at], context, begin - first[text], count


def occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    """Every context of every text, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in arrays.chunks(batches):
            values, first = unit.values(data, starts)
            text, anchor, context, start, count = contexts_of(values, first, unit.window, unit.gram)
            if len(text):
                take = pa.array(text)
                yield arrays.batch(_OCCURRENCE_ARROW, rows.column(0).take(take), rows.column(1).take(take), arrays.signed(anchor), arrays.signed(context), start, count)

    return docs.mapInArrow(run, _OCCURRENCE)


def _contents(unit: Unit, hot: bool):
    """Rows of (doc_id, row_key, text, places) to contents of the places, or to the windows of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in arrays.chunks(batches):
            values, first = unit.values(data, starts)
            places = rows.column(3)
            flat, size = places.flatten(), places.value_lengths().to_numpy()
            text = np.repeat(np.arange(len(size)), size)
            is_hot = flat.field("hot").to_numpy(zero_copy_only=False)
            pick = np.flatnonzero(is_hot == hot)
            if not len(pick):
                continue
            text, at = text[pick], pa.array(pick)
            start = flat.field("start").take(at).to_numpy().astype(np.int64) + first[text]
            count = flat.field("windows").take(at).to_numpy().astype(np.int64)
            if hot:
                hashes = arrays.RangeHash(values)
                begin, owner = arrays.gathered(start, count), np.repeat(text, count)
                take = pa.array(owner)
                yield arrays.batch(_WINDOW_ARROW, rows.column(0).take(take), rows.column(1).take(take), arrays.signed(hashes(begin, begin + unit.window)), begin - first[owner])
            else:
                units = (data if unit.content.itemsize == 1 else values.astype(unit.content))[arrays.gathered(start, count + unit.window - 1)]
                ends = np.concatenate([[0], np.cumsum((count + unit.window - 1) * unit.content.itemsize)])
                take = pa.array(text)
                yield arrays.batch(_CONTENT_ARROW, rows.column(0).take(take), rows.column(1).take(take), flat.field("anchor").take(at), flat.field("context").take(at), flat.field("start").take(at), flat.field("windows").take(at), arrays.binaries(units.view(np.uint8), ends))

    return run


@dataclass
class Repeats:
    """whole: contexts all of whose windows repeat. contents: distinct contexts that share an anchor. windows: those of hot anchors."""

    whole: DataFrame
    contents: DataFrame
    windows: DataFrame


def find(docs: DataFrame, unit: Unit, earlier: bool, hot_contexts: int = HOT_CONTEXTS) -> Repeats:
    """docs: doc_id, row_key, text. earlier: only a repeat of a smaller doc_id counts, else any other place does."""
    found = stored(occurrences(docs, unit), "contexts")
    # counts are stored before they are joined: only a join of two plain shuffles has its hot keys split at run time
    shared = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "shared-anchors")
    found = stored(found.join(shared, "anchor"), "shared-contexts")
    kinds = stored(found.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row_key", "start")).alias("least")), "context-kinds")
    several = stored(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "several-kinds")
    kinds = stored(kinds.join(several, "anchor", "left"), "counted-kinds")
    joined = found.join(kinds, ["anchor", "context"])
    if earlier:
        repeats, rest = F.col("doc_id") > F.col("least.doc_id"), F.col("doc_id") == F.col("least.doc_id")
    else:
        repeats, rest = F.col("copies") > 1, F.struct("doc_id", "row_key", "start") == F.col("least")
    places = joined.filter(rest & F.col("kinds").isNotNull()).groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("anchor", "context", "start", "windows", (F.col("kinds") > hot_contexts).alias("hot"))).alias("places")
    )
    placed = docs.join(places, ["doc_id", "row_key"]).select("doc_id", "row_key", "text", "places")
    whole = joined.filter(repeats).select("doc_id", "row_key", "start", (F.col("windows") + (unit.window - 1)).alias("size"))
    return Repeats(whole, placed.mapInArrow(_contents(unit, False), _CONTENT), placed.mapInArrow(_contents(unit, True), _WINDOW))


def anchored(contents: DataFrame, judge: Callable[[list[dict]], Iterator[tuple[int, int, int]]], unit: Unit) -> DataFrame:
    """Runs judge over the distinct contexts of each anchor, ascending by place, as they stream through sorted partitions.

    judge takes rows (doc_id, content) and yields (row, first window, number of windows) of windows to remove.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        for batch in batches:
            table = pa.Table.from_batches([b for b in (kept, batch) if b is not None]).combine_chunks()
            anchor = table.column("anchor").to_numpy()
            last = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if len(anchor) and anchor[0] != anchor[-1] else 0
            if last:
                yield _judged(table.slice(0, last), judge, unit)
            rest = table.slice(last).combine_chunks().to_batches()
            kept = rest[0] if rest else None
        if kept is not None:
            yield _judged(pa.Table.from_batches([kept]), judge, unit)

    return contents.repartition(F.col("anchor")).sortWithinPartitions("anchor", "doc_id", "row_key", "start").mapInArrow(run, SPAN)


def _judged(table: pa.Table, judge, unit: Unit) -> pa.RecordBatch:
    anchor, start, doc_id = (table.column(c).to_numpy() for c in ("anchor", "start", "doc_id"))
    content = table.column("content").to_pylist()
    edges = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
    ids = doc_id.tolist()
    row, begin, size = [], [], []
    for a, b in zip(edges, edges[1:]):
        for i, first, count in judge(ids[a:b], content[a:b]):
            row.append(a + i)
            begin.append(first)
            size.append(count + unit.window - 1)
    at = np.array(row, np.int64)
    take = pa.array(at)
    ids, keys = (table.column(c).take(take).combine_chunks() for c in ("doc_id", "row_key"))
    ids, keys = (x.chunk(0) if isinstance(x, pa.ChunkedArray) and x.num_chunks else x for x in (ids, keys))
    return arrays.batch(_SPAN_ARROW, pa.array(doc_id[at]), pa.array(table.column("row_key").to_numpy()[at]), start[at] + np.array(begin, np.int64), np.array(size, np.int64))


def hot_spans(windows: DataFrame, unit: Unit, earlier: bool) -> DataFrame:
    """Spans of the windows of hot anchors, each window hash a key of its own."""
    known = windows.groupBy("window").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
    joined = windows.join(known, "window").filter(F.col("doc_id") > F.col("least") if earlier else F.col("copies") > 1)
    # neighbours become one span, so that a long text does not gather one for each of its windows
    run = F.col("start") - F.row_number().over(Window.partitionBy("doc_id", "row_key").orderBy("start"))
    runs = joined.select("doc_id", "row_key", "start").distinct().withColumn("run", run).groupBy("doc_id", "row_key", "run")
    return runs.agg(F.min("start").alias("start"), (F.count(F.lit(1)) + (unit.window - 1)).cast("int").alias("size")).drop("run")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with spans, an array of (start, size), empty where there is none."""
    listed = spans.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    return docs.join(listed, ["doc_id", "row_key"], "left").select("doc_id", "row_key", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,size:int>>")).alias("spans"))


def covered(rows: pa.RecordBatch, first: np.ndarray, total: int) -> np.ndarray:
    """Which units of a chunk some span covers. first: the first unit of each text."""
    spans = rows.column(rows.schema.get_field_index("spans"))
    flat, size = spans.flatten(), spans.value_lengths().to_numpy()
    step = np.zeros(total + 1, np.int64)
    if len(flat):
        begin = flat.field("start").to_numpy().astype(np.int64) + np.repeat(first[:-1], size)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + flat.field("size").to_numpy(), -1)
    return np.cumsum(step[:-1]) > 0
