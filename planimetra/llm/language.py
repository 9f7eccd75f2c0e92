"""Language identification by a string kernel.

The blended-spectrum kernel of two texts is the number of byte n-grams (n from 1 to 4, ASCII letters lowered) that both
have, over the geometric mean of their numbers. Labelled texts are expanded in a Nyström basis, and one ridge regression
per language against the rest is fitted in that basis. A landmark is no chosen text but the sum of all labelled texts of
a language, each with a sign of its own, so that nothing is learned from a sample: one pass over the labelled rows sums
the landmarks, another the normal equations. The kernel is linear in n-gram presence, so the landmarks fold into one
weight per n-gram bucket and language, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.llm import arrays
from planimetra.llm.tables import small_batches

LENGTHS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Sums of all labelled texts of a language with other signs; up to 64, a bit of a hash each.
LANDMARKS_PER_LANGUAGE = 30
RIDGE = 0.1
UNDETERMINED = "und"
_ROWS = 64


def presence(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which n-gram buckets each text has, as float32 rows."""
    out = np.zeros((len(starts) - 1, BUCKETS), np.float32)
    flat, owner = out.ravel(), arrays.owners(starts)
    hashes = arrays.RangeHash(arrays.byte_values(arrays.lower_ascii(data)))
    for n in LENGTHS:
        grams = hashes.grams(n)
        whole = owner[: len(grams)] == owner[n - 1 : n - 1 + len(grams)]
        bucket = (arrays.mixed(grams + np.uint64(n)) >> np.uint64(64 - 15)).astype(np.int64)
        flat[(owner[: len(grams)] * BUCKETS + bucket)[whole]] = 1
    return out


def _few(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(starts) - 1, _ROWS):
        edge = starts[at : at + _ROWS + 1]
        yield data[edge[0] : edge[-1]], edge - edge[0]


def _normalised(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    """Runs of a batch's rows, and their presence as unit rows."""
    at = 0
    for part, edge in _few(*arrays.flat_bytes(batch.column(batch.schema.get_field_index("text")))):
        x = presence(part, edge)
        yield slice(at, at + len(x)), x / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
        at += len(x)


_SUMS = "lang string, i int, part int, n long, v binary"
_SUMS_ARROW = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("v", pa.binary())])


def _shares(lang: str, n: int, v: np.ndarray) -> pa.RecordBatch:
    """A task's share of sums over n rows: one row for each row of v."""
    part = TaskContext.get().partitionId()
    values = arrays.binaries(v.view(np.uint8).ravel(), np.arange(len(v) + 1) * v[0].nbytes)
    return arrays.batch(_SUMS_ARROW, [lang] * len(v), np.arange(len(v)), np.full(len(v), part), np.full(len(v), n), values)


def _summed(shares: DataFrame, kind: type) -> list:
    """(lang, i, n, v) added up over tasks, in the order of partitions, so that reruns agree."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int], list] = {}
        for batch in batches:
            for lang, i, n, v in zip(*(batch.column(c).to_pylist() for c in ("lang", "i", "n", "v"))):
                held = total.setdefault((lang, i), [0, 0.0])
                held[0] += n
                held[1] = held[1] + np.frombuffer(v, kind)
        for (lang, i), (n, v) in total.items():
            yield arrays.batch(_SUMS_ARROW, [lang], [i], [0], [n], [v.tobytes()])

    sums = shares.repartition("lang", "i").sortWithinPartitions("lang", "i", "part").mapInArrow(added, _SUMS).toArrow()
    return sorted(zip(*(sums.column(c).to_pylist() for c in ("lang", "i", "n", "v"))), key=lambda r: r[:2])


def _landmark_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    counts: dict[str, int] = {}
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        sign = (batch.column("signs").to_numpy()[:, None] >> np.arange(LANDMARKS_PER_LANGUAGE) & 1).astype(np.float32) * 2 - 1
        for rows, x in _normalised(batch):
            for name in set(lang[rows]):
                own = np.flatnonzero(lang[rows] == name)
                counts[name] = counts.get(name, 0) + len(own)
                if name not in sums:
                    sums[name] = np.zeros((LANDMARKS_PER_LANGUAGE, BUCKETS), np.float32)
                sums[name] += sign[rows][own].T @ x[own]
    for name, total in sums.items():
        yield _shares(name, counts[name], total)


def landmarks(rows: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """How many rows (lang, text, signs) each language has, and the landmarks of all as unit rows.

    A task's share is some megabytes, whatever its rows, so there are two tasks a core at most.
    """
    few = rows.coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    sums = _summed(few.mapInArrow(_landmark_shares, _SUMS), np.float32)
    marks = np.array([np.frombuffer(v, np.float32) for *_, v in sums]).reshape(-1, BUCKETS)
    return {lang: n for lang, _, n, _ in sums}, marks / np.maximum(np.linalg.norm(marks, axis=1), 1e-12)[:, None]


def normal_equations(rows: DataFrame, names: list[str], weight: np.ndarray, marks: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Weighted sums over rows (lang, text) of products of their coordinates in the basis with these and with the targets."""
    model = rows.sparkSession.sparkContext.broadcast((names, weight, marks, root))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weight, marks, root = model.value
        place = {name: k for k, name in enumerate(names)}
        total, n = np.zeros((root.shape[1], root.shape[1] + len(names))), 0
        for batch in batches:
            label = np.array([place[v] for v in batch.column("lang").to_pylist()], np.int64)
            for at, x in _normalised(batch):
                basis = (x @ marks.T) @ root
                target = np.where(label[at, None] == np.arange(len(names)), 1.0, -1.0)
                total += (weight[label[at], None] * basis).T @ np.column_stack([basis, target])
                n += len(x)
        if n:
            yield _shares("", n, total)

    sums = _summed(rows.mapInArrow(shares, _SUMS), np.float64)
    model.destroy()  # a file in every executor's folder
    return np.array([np.frombuffer(v, np.float64) for *_, v in sums])


def fit(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Names of the languages, and weights (buckets by languages), of all rows (lang, text, signs)."""
    counts, marks = landmarks(rows)
    if not counts:
        return [], np.zeros((BUCKETS, 0), np.float32)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    sound = value > 1e-6 * value.max()
    root = vector[:, sound] / np.sqrt(value[sound])
    # each language weighs the same, however many texts it has
    sums = normal_equations(rows, list(counts), 1 / np.array(list(counts.values())), marks, root)
    size = root.shape[1]
    solved = np.linalg.solve(sums[:, :size] + RIDGE / sum(counts.values()) * np.eye(size), sums[:, size:])
    return list(counts), (marks.T @ (root @ solved).astype(np.float32)).astype(np.float32)


def held_out() -> F.Column:
    """Whether a row's doc_id is kept from learning; a row without doc_id is."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def learned(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of all labelled rows outside the held-out fold."""
    rows = documents.select("doc_id", "text", "lang").filter(~held_out() & F.col("lang").isNotNull() & F.coalesce("text", F.lit("")).rlike("\\p{L}"))
    return fit(rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("signs")))


def identify(documents: DataFrame) -> DataFrame:
    """documents with held_out, lang_pred and score added in place of columns of these names.

    A text that is null or has no letter is 'und' with a score of 0. Without any labelled rows all are. The other
    columns pass through; only text decides.
    """
    small_batches(documents.sparkSession)
    names, weights = learned(documents)
    model = documents.sparkSession.sparkContext.broadcast((names, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = model.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            data, starts = arrays.flat_bytes(texts)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            at = 0
            for part, edge in _few(data, starts) if names else ():
                x = presence(part, edge)
                value = (x @ weights) / np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None]
                best[at : at + len(x)] = value.argmax(axis=1)
                score[at : at + len(x)] = np.clip((value.max(axis=1) + 1) / 2, 0, 1)
                at += len(x)
            known = batch.column(batch.schema.get_field_index("_letter")).to_numpy(zero_copy_only=False) & bool(names)
            predicted = [names[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
            kept = [batch.column(c) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(predicted, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    rest = documents.drop("held_out", "lang_pred", "score", "_letter")
    ready = rest.withColumn("held_out", held_out()).withColumn("_letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields[:-1])
    return ready.mapInArrow(run, f"{fields}, lang_pred string, score double")
