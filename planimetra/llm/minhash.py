"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of half-bands, A and B, take the place of many independent tables: every pair (A[i], B[j]) is a
table, so 10 + 10 half-bands of two values make 100 tables from 40 minhashes instead of 400. Two documents of
similarity 0.85 miss all tables with a probability of 2 * (1 - 0.85**2)**10, about 5 in a million; for a lower
threshold there are more half-bands, 13 + 13 for 0.8.

Links are confirmed on full shingle sets, in two rounds. First each table key links its documents to one hub of the key,
the document that meets most others: rows * tables, whatever the size of a group, and a group of close copies is one
component after it. Then what is left is judged exactly: buckets of A that still hold several components are compared
by their minhashes, only outside their largest component and only between components, and the groups of candidates
that this gives by their sets. Both are dealt as cells of a grid whose blocks hold a bounded number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.llm import arrays
from planimetra.llm.components import components
from planimetra.llm.tables import keyed, public_id, stored

SHINGLE = 5
PERCENT = 85
HALF_ROWS = 2
#: Probability at most that a pair at the threshold is in no table, and that it has too few equal values.
MISSED, UNEQUAL = 6e-6, 2e-5
#: A block of a cell: rows, and bytes of shingle sets. They bound a task's memory, and no row is left out for them.
BLOCK_ROWS = 2048
BLOCK_BYTES = 4_000_000

_U = np.uint64


@dataclass(frozen=True)
class Bands:
    """Half-bands and hashes for pairs of a similarity of percent or more."""

    percent: int

    @cached_property
    def half(self) -> int:
        """Half-bands of each collection."""
        share, n = (self.percent / 100) ** HALF_ROWS, 1
        while 2 * (1 - share) ** n > MISSED:
            n += 1
        return n

    @property
    def hashes(self) -> int:
        return 2 * self.half * HALF_ROWS

    @cached_property
    def least_equal(self) -> int:
        """Equal values below which no candidate is expected: 23 of 40 for 85, 29 of 52 for 80."""
        share, n, least = self.percent / 100, self.hashes, 0
        fewer = (1 - share) ** n
        while fewer <= UNEQUAL:
            least += 1
            fewer += comb(n, least) * share**least * (1 - share) ** (n - least)
        return least

    @cached_property
    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(11)
        return rng.integers(1, 2**63, self.hashes, dtype=np.uint64), rng.integers(1, 2**63, self.hashes, dtype=np.uint64) | _U(1)


_SIGNATURE = "doc_id long, row_key long, n_shingles long, set_sum long, set_xor long, values binary, keys array<long>, others array<long>"
_SIGNATURE_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("n_shingles", pa.int64()), ("set_sum", pa.int64()), ("set_xor", pa.int64()), ("values", pa.binary()), ("keys", pa.list_(pa.int64())), ("others", pa.list_(pa.int64()))])
_EDGE = "a long, b long"
_EDGE_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    data = arrays.lower_ascii(data)
    begin, end, first = arrays.word_bounds(data, starts)
    words = arrays.RangeHash(arrays.word_hashes(data, begin, end))
    sets, size = [], np.zeros(len(first), np.int64)
    grams = words.grams(SHINGLE)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= SHINGLE:
            sets.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif b > a:
            sets.append(words(np.array([a]), np.array([b])))
        else:
            continue
        size[i + 1] = len(sets[-1])
    return np.concatenate(sets) if sets else np.zeros(0, _U), np.cumsum(size)


def _signatures(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    hashes, (seed, odd) = bands.hashes, bands.seeds
    for rows, data, starts in arrays.chunks(batches):
        sets, edge = shingle_sets(data, starts)
        n = np.diff(edge)
        full = np.flatnonzero(n)
        at = edge[full]
        least = np.zeros((len(n), hashes), np.uint32)
        sums, xors = np.zeros(len(n), _U), np.zeros(len(n), _U)
        if len(full):
            for k in range(hashes):
                least[full, k] = np.minimum.reduceat((((sets ^ seed[k]) * odd[k]) >> _U(32)).astype(np.uint32), at)
            spread = arrays.mixed(sets)
            sums[full], xors[full] = np.add.reduceat(spread, at), np.bitwise_xor.reduceat(spread, at)
        pairs = least.astype(_U).reshape(len(n), 2, bands.half, HALF_ROWS)
        keys = arrays.mixed(arrays.mixed(pairs[..., 0] << _U(32) | pairs[..., 1]) + np.arange(bands.half, dtype=_U))
        values = arrays.binaries(least.astype(np.uint8).ravel(), np.arange(len(n) + 1) * hashes)
        edges = pa.array(np.arange(len(n) + 1) * bands.half, pa.int32())
        listed = [pa.ListArray.from_arrays(edges, pa.array(arrays.signed(np.ascontiguousarray(keys[:, c]).ravel()))) for c in (0, 1)]
        yield arrays.batch(_SIGNATURE_ARROW, rows.column(0), rows.column(1), n, arrays.signed(sums), arrays.signed(xors), values, *listed)


def _joined(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(larger, least) node pairs that join what linked joins. left, right: node of each row and column; nodes may repeat."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    label = np.arange(len(nodes), dtype=np.int32)
    while True:
        new = label.copy()
        np.minimum.at(new, a, np.where(linked, label[b][None, :], np.int32(len(nodes))).min(axis=1, initial=len(nodes)))
        np.minimum.at(new, b, np.where(linked, label[a][:, None], np.int32(len(nodes))).min(axis=0, initial=len(nodes)))
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return np.stack([nodes[moved], nodes[label[moved]]], axis=1)
        label = new


def _similar(left: np.ndarray, right: np.ndarray, least_equal: int) -> np.ndarray:
    """Which rows of left and right, both of one bucket of A, also share a half-band of B and enough values."""
    equal = np.zeros((len(left), len(right)), np.uint8)
    for x, y in zip(left.T, right.T):
        equal += x[:, None] == y[None, :]
    shared = np.zeros(equal.shape, bool)
    half = left.shape[1] // 2
    for x, y in zip(*(np.ascontiguousarray(side[:, half:]).view(np.uint16).T for side in (left, right))):
        shared |= x[:, None] == y[None, :]
    return shared & (equal >= least_equal)


def _groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Whole groups of equal names, several at a time, from sorted rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for name in names:
            x = batch.column(name).to_numpy()
            new[1:] |= x[1:] != x[:-1]
            if kept:
                new[0] |= x[0] != kept[-1].column(name)[-1].as_py()
        cut = np.flatnonzero(new)
        if len(cut):
            if int(cut[-1]) or kept:
                yield pa.Table.from_batches([*kept, *([batch.slice(0, int(cut[-1]))] if cut[-1] else [])]).combine_chunks()
            kept = [batch.slice(int(cut[-1]))]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _edges_of(table: pa.Table, names: tuple[str, ...]) -> list[int]:
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for name in names:
        x = table.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return [*np.flatnonzero(new).tolist(), table.num_rows]


_DEAL = ("key", "u", "v")


def _cells(batches: Iterator[pa.RecordBatch], payload: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """doc_id, component, whether a row is of the left side, and payload of each cell."""
    for table in _groups(batches, _DEAL):
        ids, component, left = (table.column(c).to_numpy() for c in ("doc_id", "component", "left"))
        carried = table.column(payload).to_pylist()
        edges = _edges_of(table, _DEAL)
        for x, y in zip(edges, edges[1:]):
            yield ids[x:y], component[x:y], left[x:y], carried[x:y]


def _edge_batches(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Edges of many small cells in few batches."""
    kept, n = [], 0
    for found in pairs:
        kept.append(found)
        n += len(found)
        if n > 10_000:
            yield _edge_batch(kept)
            kept, n = [], 0
    if n:
        yield _edge_batch(kept)


def _edge_batch(kept: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.unique(np.concatenate(kept), axis=0).T
    return arrays.batch(_EDGE_ARROW, a.copy(), b.copy())


def _candidates(batches: Iterator[pa.RecordBatch], bands: Bands) -> Iterator[pa.RecordBatch]:
    """Pairs of components that the minhashes hold to be linked."""

    def pairs() -> Iterator[np.ndarray]:
        for _, component, left, carried in _cells(batches, "values"):
            values = np.frombuffer(b"".join(carried), np.uint8).reshape(-1, bands.hashes)
            a, b = component[left], component[~left]
            yield _joined(_similar(values[left], values[~left], bands.least_equal) & (a[:, None] != b[None, :]), a, b)

    yield from _edge_batches(pairs())


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of left and right are linked. Only shingles that both sides have are counted."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    kinds = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places, owners = [], []
    for side, size in zip((left, right), sizes):
        flat = np.concatenate(side)
        place = np.searchsorted(kinds, flat)
        known = np.flatnonzero(kinds[np.minimum(place, len(kinds) - 1)] == flat) if len(kinds) else np.zeros(0, np.int64)
        order = known[np.argsort(place[known], kind="stable")]
        places.append(place[order])
        owners.append(np.repeat(np.arange(len(side)), size)[order])
    common = np.zeros((len(left), len(right)), np.float32)
    width = 2048
    for at in range(0, len(kinds), width):
        parts = []
        for place, owner, size in zip(places, owners, sizes):
            a, b = np.searchsorted(place, [at, at + width])
            part = np.zeros((len(size), width), np.float32)
            part[owner[a:b], place[a:b] - at] = 1
            parts.append(part)
        common += parts[0] @ parts[1].T
    return 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links between the documents of the two sides of each cell that are in different components."""

    def pairs() -> Iterator[np.ndarray]:
        for ids, component, left, carried in _cells(batches, "shingles"):
            if left.all() or not left.any():
                continue
            sets = [np.frombuffer(s, _U) for s in carried]
            a, b = ([sets[i] for i in np.flatnonzero(side)] for side in (left, ~left))
            if len(a) == len(b) == 1:
                common = len(np.intersect1d(a[0], b[0], assume_unique=True))
                found = np.array([[100 * common >= percent * (len(a[0]) + len(b[0]) - common)]])
            else:
                found = _linked(a, b, percent)
            yield _joined(found & (component[left][:, None] != component[~left][None, :]), ids[left], ids[~left])

    yield from _edge_batches(pairs())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
    for rows, data, starts in arrays.chunks(batches):
        sets, edge = shingle_sets(data, starts)
        yield arrays.batch(schema, rows.column("doc_id"), arrays.binaries(sets.view(np.uint8), edge * 8))


def _met(tables: DataFrame) -> DataFrame:
    """(key, doc_id, n) of the table keys that n > 1 documents share. tables: key, doc_id."""
    counts = stored(tables.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "table-sizes")
    return tables.join(counts, "key")


def _hubs(met: DataFrame) -> DataFrame:
    """(doc_id, hub) for every document of a table key but its hub.

    The hub of a key is the document that meets most others over all its keys, the least of several: what lies in the
    middle of a group is linked with more of it than its first document is.
    """
    degrees = met.groupBy("doc_id").agg(F.sum("n").alias("degree"))
    hubs = met.select("key", "doc_id").join(degrees, "doc_id").groupBy("key").agg(F.max(F.struct("degree", F.bitwise_not("doc_id").alias("turned"))).alias("top"))
    hubs = stored(hubs.select("key", F.bitwise_not("top.turned").alias("hub")), "hubs")
    return met.select("key", "doc_id").join(hubs, "key").filter("doc_id != hub").select("doc_id", "hub").distinct()


def _grid(rows: DataFrame, size, rows_of_block: int, bytes_of_block: int) -> DataFrame:
    """Cells (key, u, v) of blocks of the rows outside a key's largest component (left) and of all its rows.

    rows: key, doc_id, component. size: bytes of a row. Every pair of rows in different components is in a cell, and a
    row is in as many cells as the other side has blocks.
    """
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    totals = parts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "bytes", "component")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).filter("parts > 1")
    blocks = lambda n, b: F.greatest(F.ceil(n / rows_of_block), F.ceil(b / bytes_of_block), F.lit(1)).cast("int")
    totals = totals.select("key", F.col("top.component").alias("_most"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("_us"), blocks(F.col("n"), F.col("bytes")).alias("_vs"))
    known = rows.join(stored(totals, "grid-keys"), "key")
    u, v = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col(c)).cast("int") for c in ("_us", "_vs"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = known.filter("component != _most").withColumns({"u": u, "left": F.lit(True)}).withColumn("v", every("_vs"))
    right = known.withColumns({"v": v, "left": F.lit(False)}).withColumn("u", every("_us"))
    return left.unionByName(right).drop("_most", "_us", "_vs")


def _stars(edges: DataFrame, sizes: DataFrame, bytes_of_block: int) -> DataFrame:
    """Cells of each hub against blocks of its documents. edges: doc_id, hub. sizes: doc_id, bytes."""
    sized = stored(edges.join(sizes, "doc_id"), "star-edges")
    totals = stored(sized.groupBy("hub").agg(F.ceil(F.sum("bytes") / bytes_of_block).cast("int").alias("blocks")), "star-sizes")
    right = sized.join(totals, "hub").select(F.col("hub").alias("key"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("u"), "doc_id", F.lit(False).alias("left"))
    left = totals.select(F.col("hub").alias("key"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("u"), F.col("hub").alias("doc_id"), F.lit(True).alias("left"))
    return left.unionByName(right).select("key", "u", F.lit(0).alias("v"), "doc_id", F.col("doc_id").alias("component"), "left")


def _dealt(cells: DataFrame, payload: str) -> DataFrame:
    return cells.select(*_DEAL, "doc_id", "component", "left", payload).repartition(*_DEAL).sortWithinPartitions(*_DEAL, F.desc("left"), "doc_id")


def near_duplicates(documents: DataFrame, percent: int = PERCENT, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept of each row of documents.

    A-Z are lowered, words are runs without ASCII white space, and a set holds the distinct 5-word shingles (with fewer
    words, all of them as one). Documents with 100 * common >= percent * union are linked; component_id is the least doc_id
    that can be reached. Empty and null texts are linked with nothing. Rows that repeat a doc_id are one document as to
    links. A null doc_id is below all others and comes back as null; where it leads a group, so does component_id, and
    kept tells whether a row is that leader. Other columns play no part.
    """
    docs, bands = keyed(documents), Bands(percent)
    signed = stored(docs.mapInArrow(partial(_signatures, bands=bands), _SIGNATURE), "signatures")
    identity = ["n_shingles", "set_sum", "set_xor"]
    kinds = signed.filter("n_shingles > 0").groupBy(*identity).agg(F.min(F.struct("doc_id", "row_key")).alias("first"))
    kinds = stored(kinds.select(*identity, "first.doc_id", "first.row_key"), "kinds")
    ids = kinds.select("doc_id", "row_key")
    # buckets of A that hold two documents at least; only in them can a table key be shared
    banded = signed.join(ids, ["doc_id", "row_key"], "left_semi").select(F.explode("keys").alias("key"), "doc_id", "values", "others")
    shared = stored(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "shared-keys")
    buckets = stored(banded.join(shared, "key"), "buckets")

    tables = stored(buckets.select("doc_id", F.explode("others").alias("other"), "key").select(F.xxhash64("key", "other").alias("key"), "doc_id"), "tables")
    met = stored(_met(tables), "met")
    # texts are shuffled once, and sets made once, for all documents that share a table key
    chosen = ids.join(met.select("doc_id").distinct(), "doc_id")
    sets = stored(docs.join(chosen, ["doc_id", "row_key"]).select("doc_id", "text").mapInArrow(_sets, "doc_id long, shingles binary"), "shingle-sets")

    def confirmed(cells: DataFrame) -> DataFrame:
        return _dealt(cells.join(sets, "doc_id"), "shingles").mapInArrow(partial(_confirmed, percent=percent), _EDGE)

    sizes = kinds.groupBy("doc_id").agg(F.sum(8 * F.col("n_shingles")).alias("bytes"))
    near = stored(components(confirmed(_stars(_hubs(met), sizes, block_bytes))), "near-hubs")
    labelled = lambda rows: rows.join(near.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rest = _grid(labelled(buckets.select("key", "doc_id", "values")), F.length("values"), block_rows, block_bytes)
    groups = stored(components(_dealt(rest, "values").mapInArrow(partial(_candidates, bands=bands), _EDGE)), "candidate-groups")
    members = labelled(ids.select("doc_id").distinct()).join(groups.select(F.col("node").alias("component"), F.col("component").alias("key")), "component").join(sizes, "doc_id")
    cells = _grid(members, F.col("bytes"), block_rows, block_bytes).drop("bytes")
    found = components(confirmed(cells).unionByName(near.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
    leads = kinds.join(found, kinds.doc_id == found.node, "left").select(*identity, F.coalesce("component", "doc_id").alias("component_id"))
    joined = signed.join(leads, identity, "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return joined.select(
        public_id(), "row_key", "n_shingles", public_id("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept")
    )


def keep_first(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near duplicates: that with the least doc_id, and of rows that repeat it the first by text.

    Empty and null texts are in no group, so their rows all stay. Columns pass through.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    leads = near_duplicates(documents, percent=percent).filter("n_shingles = 0 or kept").select(F.coalesce("doc_id", F.lit(-(2**63))).alias("_doc"), F.col("row_key").alias("_row"), (F.col("n_shingles") > 0).alias("_one")).distinct()
    rows = documents.withColumns({"_doc": doc_id, "_row": F.xxhash64(doc_id, F.coalesce("text", F.lit("")))}).join(leads, ["_doc", "_row"])
    # rows that all stay get a number of their own, so that one filter on the rank is left, which Spark applies before the shuffle
    rows = rows.withColumn("_own", F.when(~F.col("_one"), F.monotonically_increasing_id()))
    turn = F.row_number().over(Window.partitionBy("_doc", "_row", "_own").orderBy("_row"))
    return rows.withColumn("_turn", turn).filter("_turn = 1").select(*documents.columns)
