"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into pieces of 32 words at most. A randomised SVD of all TF-IDF passages of 32 words, the benchmark's and the
documents', gives a term basis; its passes over the passages are distributed and only term-by-rank sums of a fixed size come to the
driver. Every document is covered by windows of 16 and of 32 words, each half over the next, and a piece is compared with the windows of
its own size: those with a high cosine in the latent space are its candidates, and nothing else is. The basis spans the benchmark, so what else
stands in a window hardly counts, and reworded pieces stay near. Candidates are checked on their words, with some words around
the window: the longest common subsequence must cover most of the piece, or, for a paraphrase, half of it and nearly all of the
item's answer, its last sentence, nearby.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.llm import arrays
from planimetra.llm.tables import small_batches, stored

BLOCK = 32
TERM_BITS = 14
RANK = 128
OVERSAMPLE = 10
PASSES = 2
#: Passages of one text that are multiplied at once, which bounds a task's memory. No sample is taken: the SVD and term frequencies take all.
SAMPLE_PASSAGES = 20_000
#: Squared weight of all benchmark passages together over that of the documents'.
BENCHMARK_MASS = 1.3
#: Least cosine of a candidate. Pieces under LEAST_WORDS fill a smaller part of their window and need less, by the root of their share.
COSINE = 0.65
#: Windows are sums of groups of STEP words: WINDOWS of two and of four.
STEP = 8
WINDOWS = (16, 32)
#: Words on either side of a window that count as part of it when words are checked, since a piece may lie between two windows.
BESIDE = 16
COVERED, PARAPHRASED, ANSWERED = 0.7, 0.5, 0.8
#: Shorter items must occur whole.
LEAST_WORDS = 8
#: Items that are looked for in one pass over the documents.
QUERY_BLOCK = 5_000

_U = np.uint64
_TERMS = 1 << TERM_BITS
_TABLE = arrays.letters_table()
_LOWERED = arrays.byte_values(arrays.lower_ascii(np.arange(256, dtype=np.uint8)))
_CHUNK = 250_000
#: Candidates that are checked at once.
_HELD = 1 << 15
_SLOTS = 1024
#: Terms that a chunk has more often than this are summed by a product of matrices, this many terms at once.
_OFTEN = 64


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (lowered letters, digits and apostrophes) and each text's first."""
    begin, end, first = arrays.word_bounds(data, starts, _TABLE)
    return arrays.RangeHash(_LOWERED[data])(begin, end), first


def terms_of(code: np.ndarray) -> np.ndarray:
    return (code >> _U(64 - TERM_BITS)).astype(np.int64)


def slots_of(code: np.ndarray) -> np.ndarray:
    return (code & _U(_SLOTS - 1)).astype(np.int64)


def block_starts(first: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """First word of each block, and each text's first block."""
    count = -(-np.diff(first) // size)
    edge = np.concatenate([[0], np.cumsum(count)])
    within = np.arange(edge[-1]) - np.repeat(edge[:-1], count)
    return np.repeat(first[:-1], count) + within * size, edge


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of a chunk of texts, and how many each passage has."""
    schema = pa.schema([("terms", pa.binary()), ("sizes", pa.binary())])
    for _, data, starts in arrays.chunks(batches, _CHUNK):
        code, first = words(data, starts)
        at, _ = block_starts(first)
        if len(at):
            size = np.diff(np.append(at, len(code)))
            yield arrays.batch(schema, [terms_of(code).astype(np.int16).tobytes()], [size.astype(np.uint8).tobytes()])


def _runs(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row, terms and sizes of most passages at once."""
    for row, (terms, sizes) in enumerate(zip(batch.column(0), batch.column(1))):
        term, size = np.frombuffer(terms.as_buffer(), np.int16), np.frombuffer(sizes.as_buffer(), np.uint8)
        edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        for low in range(0, len(size), most):
            high = min(low + most, len(size))
            yield row, term[edge[low] : edge[high]].astype(np.int64), size[low:high].astype(np.int64)


def _counted(term: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term and number of each different term of a passage."""
    key = np.sort(np.repeat(np.arange(len(size)), size) << TERM_BITS | term)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> TERM_BITS, key[first] & (_TERMS - 1), np.diff(np.append(first, len(key)))


def _frequencies(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many passages a term is, and under _TERMS how many there are, of documents and of the benchmark."""
        total = np.zeros((2, _TERMS + 1), np.int64)
        for batch in batches:
            own = batch.column(2).to_numpy(False).astype(int)
            for row, term, size in _runs(batch, most):
                total[own[row], :-1] += np.bincount(_counted(term, size)[1], minlength=_TERMS)
                total[own[row], -1] += len(size)
        whose, some = np.nonzero(total)
        yield arrays.batch(pa.schema([("own", pa.bool_()), ("term", pa.int32()), ("n", pa.int64())]), whose == 1, some, total[whose, some])

    return run


def random_basis(width: int) -> np.ndarray:
    return np.random.default_rng(5).standard_normal((_TERMS, width), np.float32)


def _sums(rows: np.ndarray, index: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of rows[index] over size[i] places from first[i] on; one step takes a row of every sum that has more."""
    order = None if (np.diff(size) <= 0).all() else np.argsort(-size, kind="stable")
    if order is not None:
        first, size = first[order], size[order]
    out = np.zeros((len(size), rows.shape[1]), np.float32)
    held = np.empty_like(out)
    for k, n in enumerate(np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")):
        np.take(rows, index[first[:n] + k], axis=0, out=held[:n], mode="clip")
        out[:n] += held[:n]
    if order is not None:
        held[order] = out
        return held
    return out


def _multiplied(idf, held, width: int, most: int, weight: float):
    """Partial sums of S'(S basis) by term, for the unit TF-IDF rows S of passages (terms, sizes, own); the benchmark's own weigh more.

    held is a broadcast basis; without one, tasks draw the random basis themselves, which is cheaper than sending it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = (random_basis(width) if held is None else held.value) * idf.value[:, None]
        out = np.zeros(weighted.shape, np.float32)
        used = np.zeros(_TERMS, bool)
        for batch in batches:
            own = batch.column(2).to_pylist()
            for row, term, size in _runs(batch, most):
                whose, kind, count = _counted(term, size)
                square = np.bincount(whose, (count * idf.value[kind]) ** 2, minlength=len(size))
                scale = np.divide(weight**2 if own[row] else 1.0, square, out=np.zeros(len(size)), where=square > 0)
                product = _sums(weighted, term, np.cumsum(size) - size, size) * scale[:, None].astype(np.float32)
                passage = np.repeat(np.arange(len(size)), size)
                n = np.bincount(term, minlength=_TERMS)
                used |= n > 0
                order, at = np.argsort(term.astype(np.int16), kind="stable"), np.cumsum(n) - n
                often, rest = np.flatnonzero(n > _OFTEN), np.flatnonzero((n > 0) & (n <= _OFTEN))
                rest = rest[np.argsort(-n[rest], kind="stable")]
                for term_ in (often[i : i + _OFTEN] for i in range(0, len(often), _OFTEN)):
                    place = order[arrays.gathered(at[term_], n[term_])]
                    cell = np.repeat(np.arange(len(term_)), n[term_]) * len(size) + passage[place]
                    out[term_] += np.bincount(cell, minlength=len(term_) * len(size)).reshape(len(term_), -1).astype(np.float32) @ product
                out[rest] += _sums(product, passage[order], at[rest], n[rest])
        some = np.flatnonzero(used)
        out = out[some] * idf.value[some, None]
        yield arrays.batch(pa.schema([("term", pa.int32()), ("part", pa.binary())]), some, arrays.binaries(out.view(np.uint8).ravel(), np.arange(len(some) + 1) * 4 * out.shape[1]))

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for term, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            part = np.frombuffer(part, np.float32)
            sums[term] = sums[term] + part if term in sums else part.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())], names=["term", "part"])


def _table_of(parts: pa.Table, width: int) -> np.ndarray:
    """Dense rows by term from (term, part), without a second copy of the parts."""
    out = np.zeros((_TERMS, width), np.float32)
    for batch in parts.to_batches():
        part = batch.column(1)
        ends = np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1]
        out[batch.column(0).to_numpy()] = np.frombuffer(part.buffers()[2], np.float32)[ends[0] // 4 : ends[-1] // 4].reshape(-1, width)
    return out


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Basis of the columns' span from their small Gram matrix; twice for full accuracy."""
    value, vector = np.linalg.eigh((x.T @ x).astype(np.float64))
    scale = np.where(value > 1e-10 * max(value.max(), 1e-30), 1 / np.sqrt(np.maximum(value, 1e-300)), 0)
    return x @ (vector * scale).astype(np.float32)


@dataclass
class Latent:
    """Term basis with the idf in it, so that a passage is the sum of its terms' rows."""

    idf: np.ndarray
    rows: np.ndarray

    def blocks(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of the rows of the terms from each start to the next; no block has more than BLOCK."""
        return _sums(self.rows, term, at, np.diff(np.append(at, len(term))))


def fit(documents: DataFrame, benchmark: DataFrame, rank: int = RANK) -> Latent:
    spark = documents.sparkSession
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    items = benchmark.select(F.coalesce("text", F.lit("")).alias("text"))
    kinds = "terms binary, sizes binary"
    passages = texts.mapInArrow(_passages, kinds).withColumn("own", F.lit(False)).unionByName(items.mapInArrow(_passages, kinds).withColumn("own", F.lit(True)))
    # a task's sums are some megabytes, whatever its rows, so there are two tasks a core at most
    passages = stored(passages, "passages").coalesce(2 * spark.sparkContext.defaultParallelism)
    counted = passages.mapInArrow(_frequencies(SAMPLE_PASSAGES), "own boolean, term int, n long").groupBy("own", "term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros((2, _TERMS + 1), np.int64)
    frequency[counted.column("own").to_numpy().astype(int), counted.column("term").to_numpy()] = counted.column("n").to_numpy()
    total, own = (max(1, int(n)) for n in frequency[:, -1])
    idf = np.log((total + 1) / (frequency[0, :-1] + 0.5)).astype(np.float32)
    weight = float(np.sqrt(BENCHMARK_MASS * total / own))
    shared_idf = spark.sparkContext.broadcast(idf)
    width = rank + OVERSAMPLE
    basis = random_basis(width)
    for step in range(PASSES + 1):
        held = spark.sparkContext.broadcast(basis) if step else None
        parts = passages.mapInArrow(_multiplied(shared_idf, held, width, SAMPLE_PASSAGES, weight), "term int, part binary")
        product = _table_of(parts.repartition("term").mapInArrow(_added, "term int, part binary").toArrow(), width)
        if held is not None:
            held.destroy()  # each is a file in every executor's folder
        if step == PASSES:  # Rayleigh-Ritz in the basis that the passes have found
            square = (basis.T @ product).astype(np.float64)
            value, vector = np.linalg.eigh((square + square.T) / 2)
            basis = basis @ vector[:, np.argsort(-value)[:rank]].astype(np.float32)
        else:
            basis = _orthonormal(_orthonormal(product))
        del product
    shared_idf.destroy()
    basis *= idf[:, None]
    return Latent(idf, basis)


@dataclass
class Queries:
    """Pieces of benchmark items, ready to be compared."""

    items: list[int | None] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    masks: list[dict[int, int]] = field(default_factory=list)
    answers: list[dict[int, int]] = field(default_factory=list)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))
    #: Which slots of a small table the words of each piece fall into.
    slots: np.ndarray = field(default_factory=lambda: np.zeros((0, _SLOTS), bool))

    def of_window(self, width: int) -> np.ndarray:
        """Pieces that are compared with windows of this width: the smallest that hold them."""
        size = np.array(self.lengths)
        return np.flatnonzero((size <= width) & (size > max([0, *(w for w in WINDOWS if w < width)])))

    def least(self) -> np.ndarray:
        """The least cosine of each piece's candidates."""
        return COSINE * np.sqrt(np.minimum(1, np.array(self.lengths) / LEAST_WORDS))


def mask_of(code: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(code):
        out[w] = out.get(w, 0) | 1 << i
    return out


def common(masks: dict[int, int], length: int, code: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    whole = (1 << length) - 1
    row = whole
    for w in code:
        m = masks.get(w)
        if m is not None:
            hit = row & m
            row = ((row + hit) | (row - hit)) & whole
    return length - row.bit_count()


def queries(rows: list[tuple[int | None, str | None]], latent: Latent) -> Queries:
    out, pieces = Queries(), []
    for item, text in rows:
        data, starts = arrays.flat_bytes(pa.array([text or ""]))
        code = words(data, starts)[0]
        if not len(code):
            continue
        last = re.split(r"(?<=[.!?])\s+", text.strip())[-1]
        data, starts = arrays.flat_bytes(pa.array([last]))
        answer = words(data, starts)[0].tolist()
        n = len(code)
        for at in sorted({max(0, min(a, n - BLOCK)) for a in range(0, n, BLOCK)}):
            piece = code[at : at + BLOCK]
            out.items.append(item)
            out.lengths.append(len(piece))
            out.masks.append(mask_of(piece.tolist()))
            out.answers.append(mask_of(answer) | {-1: len(answer)})
            pieces.append(piece)
    if pieces:
        at = np.concatenate([[0], np.cumsum(out.lengths)[:-1]])
        out.vectors = _unit(latent.blocks(terms_of(np.concatenate(pieces)), at))
        out.slots = np.zeros((len(pieces), _SLOTS), bool)
        for k, piece in enumerate(pieces):
            out.slots[k, slots_of(piece)] = True
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]


def verdict(query: Queries, k: int, code: list[int], around: list[int]) -> float:
    """Share of the piece in the longest common subsequence if that makes a match, else 0."""
    length = query.lengths[k]
    share = common(query.masks[k], length, code) / length
    if length < LEAST_WORDS:
        return 1.0 if share == 1 and _whole(query.masks[k], length, code) else 0.0
    if share >= COVERED:
        return share
    if share >= PARAPHRASED:
        answer = query.answers[k]
        n = answer[-1]
        if n and common({w: m for w, m in answer.items() if w != -1}, n, around) >= ANSWERED * n:
            return share
    return 0.0


def _whole(masks: dict[int, int], length: int, code: list[int]) -> bool:
    state = 0
    for w in code:
        state = (state << 1 | 1) & masks.get(w, 0)
        if state >> (length - 1) & 1:
            return True
    return False


def candidates(code: np.ndarray, first: np.ndarray, latent: Latent, query: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and piece of each pair of window and piece with a high cosine; windows end with their text."""
    at, edge = block_starts(first, STEP)
    sums = latent.blocks(terms_of(code), at)
    text = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    within = np.arange(len(at)) - edge[:-1][text]
    least = query.least()
    found = []
    for width in WINDOWS:
        own = query.of_window(width)
        groups = width // STEP
        begin = np.flatnonzero(within % (groups // 2) == 0)
        if not len(own) or not len(begin):
            continue
        window = sums[begin]
        for k in range(1, groups):
            more = np.flatnonzero(begin + k < edge[text[begin] + 1])
            window[more] += sums[begin[more] + k]
        window = _unit(window)
        for low in range(0, len(own), 2048):
            piece = own[low : low + 2048]
            where, k = np.divmod(np.flatnonzero(window @ query.vectors[piece].T >= least[piece]), len(piece))
            found.append((text[begin[where]], at[begin[where]], piece[k]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def matches(data: np.ndarray, starts: np.ndarray, latent: Latent, query: Queries) -> list[tuple[int, float]]:
    """For each text the best piece (or -1) and its share."""
    code, first = words(data, starts)
    best = [(-1, 0.0)] * (len(starts) - 1)
    if not len(code) or not len(query.items):
        return best
    text, begin, piece = candidates(code, first, latent, query)
    length = np.array(query.lengths)
    width = np.array(WINDOWS)[np.searchsorted(WINDOWS, length[piece])]
    slot = slots_of(code)
    needed = np.where(length < LEAST_WORDS, length, np.ceil(PARAPHRASED * length))
    low, high = np.maximum(first[text], begin - BESIDE), np.minimum(first[text + 1], begin + width + BESIDE)
    kept = []
    for a in range(0, len(piece), _HELD):
        some = slice(a, a + _HELD)
        place = low[some, None] + np.arange(max(WINDOWS) + 2 * BESIDE)
        inside = place < high[some, None]
        # no common subsequence is longer than the number of words there that the piece has too
        shared = (query.slots[piece[some, None], slot[np.where(inside, place, 0)]] & inside).sum(axis=1)
        kept.append(a + np.flatnonzero(shared >= needed[piece[some]]))
    for i in np.concatenate(kept).tolist() if kept else ():
        t, k = int(text[i]), int(piece[i])
        if best[t][1] == 1:
            continue
        own = code[low[i] : high[i]].tolist()
        around = code[max(first[t], low[i] - BESIDE) : min(first[t + 1], high[i] + 3 * BESIDE)].tolist()
        got = verdict(query, k, own, around)
        if got > best[t][1]:
            best[t] = (k, got)
    return best


def flag(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents with item_id, overlap and contaminated added in place of columns of these names.

    overlap is the share of the best matching piece that is in the document, 0 without a match, and item_id its item.
    Null or empty texts and items match nothing; items without item_id match under a null id. Items shorter than
    LEAST_WORDS must occur whole. Every row is judged by its whole text, repeats alike; there is no shuffle of texts.
    The benchmark is taken in blocks of QUERY_BLOCK items, each one pass over the documents.
    """
    spark = documents.sparkSession
    small_batches(spark)
    new = ["item_id", "overlap", "contaminated"]
    names = [c for c in documents.columns if c not in new]
    latent = fit(documents, benchmark)
    shared = spark.sparkContext.broadcast(latent)
    out = documents.select(*names, F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("overlap"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields)
    rows: list[tuple[int | None, str | None]] = []

    def passed(table: DataFrame, query: Queries) -> DataFrame:
        held = spark.sparkContext.broadcast(query)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, starts in arrays.chunks(batches, _CHUNK):
                found = matches(data, starts, shared.value, held.value)
                item, overlap = part.column(part.num_columns - 2).to_pylist(), part.column(part.num_columns - 1).to_pylist()
                for i, (k, share) in enumerate(found):
                    if share > overlap[i]:
                        item[i], overlap[i] = held.value.items[k], share
                kept = [part.column(c) for c in range(part.num_columns - 2)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(item, pa.int64()), pa.array(overlap, pa.float64())], names=part.schema.names)

        return table.mapInArrow(run, fields)

    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        rows.append((r.item_id, r.text))
        if len(rows) == QUERY_BLOCK:
            out, rows = passed(out, queries(rows, latent)), []
    if rows:
        out = passed(out, queries(rows, latent))
    return out.withColumn("contaminated", F.col("overlap") > 0)
