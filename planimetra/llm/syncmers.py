"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers stands at either edge. Whether it is one
depends on nothing around it, so the same passage gives the same anchors in any text. A fingerprint keeps the anchors
with hashes in the lowest eighth, and always the ANCHORS least ones, together with their place, in text order; two
fingerprints are compared by the longest chain of equal anchors that stand in the same order in both. The number of
anchors grows with the text, so that a long text's likeness gets no coarser and its passages keep anchors of their own.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.llm import arrays
from planimetra.llm.tables import public_id, small_batches

K = 20
S = 9
#: All of a text's anchors up to this many, and of any text those with a hash below the bound: an eighth of all hashes.
ANCHORS = 96
BOUND = 1 << 37

_U = np.uint64
_EMPTY = ""


def anchors(points: np.ndarray, first: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place in it and 40-bit hash of every closed syncmer of texts of code points laid end to end."""
    if len(points) < k:
        none = np.zeros(0, np.int64)
        return none, none, none.view(_U)
    hashes = arrays.RangeHash(arrays.mixed(points.astype(_U) + _U(1)))
    inner = hashes.grams(s)
    least = arrays.sliding_min(inner, k - s + 1)
    n = len(least)
    closed = (inner[:n] == least) | (inner[k - s : k - s + n] == least)
    owner = arrays.owners(first)
    at = np.flatnonzero(closed & (owner[:n] == owner[k - 1 : k - 1 + n]))
    return owner[at], at - first[owner[at]], hashes(at, at + k) >> _U(24)


def fingerprints(texts: list[str], kept: int = ANCHORS) -> list[str]:
    """One per text: the kept least anchors and all below BOUND as 'hash:place' in hexadecimal, in text order.

    A text without anchors is its own.
    """
    raw = "".join(texts).encode("utf-32-le")
    points = np.frombuffer(raw, np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    owner, place, code = anchors(points, first)
    edge = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for text, a, b in zip(texts, edge[:-1].tolist(), edge[1:].tolist()):
        if not text:
            out.append(_EMPTY)
        elif a == b:
            out.append(hashlib.sha256(text.encode()).hexdigest()[:10] + ":0")
        else:
            value, where = np.unique(code[a:b], return_index=True)
            order = np.sort(where[: max(kept, int(np.searchsorted(value, BOUND)))])
            out.append(" ".join(f"{c:010x}:{p:x}" for c, p in zip(code[a + order].tolist(), place[a + order].tolist())))
    return out


def likeness(one: str, other: str) -> float:
    """0 to 1: anchors in the longest common chain over all anchors that both fingerprints could know of."""
    if one == other:
        return 1.0
    if not one or not other:
        return 0.0
    a = [x.split(":")[0] for x in one.split(" ")]
    b = {x.split(":")[0]: i for i, x in enumerate(other.split(" "))}
    # anchors above the lesser of the two largest hashes, or above the bound, may be cut off in one of them
    limit = min(max(*x, f"{BOUND - 1:010x}") if len(x) >= ANCHORS else "g" for x in (a, b))
    known_a, known_b = sum(x <= limit for x in a), sum(x <= limit for x in b)
    tails: list[int] = []
    for place in (b[x] for x in a if x <= limit and x in b):
        at = bisect_left(tails, place)
        tails[at : at + 1] = [place]
    return len(tails) / (known_a + known_b - len(tails))


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_GROUP_CHARS = 300_000


def _compared(run: list[tuple[int, str, bool]], following: tuple[int, str] | None) -> pa.RecordBatch:
    """run: (doc_id, text, whether to answer) in order; following: what comes after the last of them."""
    texts = [t for _, t, _ in run]
    after = [*texts[1:], *([following[1]] if following else [texts[-1]])]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
    marks = fingerprints([*texts, *edited, *after[-1:]])
    own, changed = marks[: len(texts)], marks[len(texts) : -1]
    nexts = [*own[1:], marks[-1]]
    keep = [i for i, row in enumerate(run) if row[2]]
    return arrays.batch(
        _RESULT_ARROW,
        pa.array([run[i][0] for i in keep], pa.int64()),
        pa.array([len(texts[i]) for i in keep], pa.int64()),
        pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in keep], pa.string()),
        pa.array([own[i] for i in keep], pa.string()),
        pa.array([changed[i] for i in keep], pa.string()),
        pa.array([likeness(own[i], changed[i]) for i in keep], pa.float64()),
        pa.array([likeness(own[i], nexts[i]) for i in keep], pa.float64()),
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, doc_id, text, guest) to results; the guest that ends a part only tells what comes next."""
    run: list[tuple[int, str, bool]] = []
    part, size = None, 0
    for batch in batches:
        for p, d, text, guest in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "guest"))):
            if run and (p != part or size > _GROUP_CHARS):
                yield _compared(run, (d, text) if p == part else None)
                run, size = [], 0
            part = p
            run.append((d, text, not guest))
            size += len(text)
    if run:
        yield _compared(run, None)


def fingerprint_documents(documents: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next document is the one with the next smaller doc_id, after the last the first; rows with equal ids follow
    each other by text, and null ids (which stay null) come last. A null text is empty. A table of one row is its own next. An
    empty fingerprint is like an empty one only. Other columns play no part.

    Documents are cut into ranges of doc_id at approximate quantiles; each range is sorted by itself and gets the first
    document of the range after it as a guest, so nothing is sorted or passed on globally.
    """
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.lit(cuts), lambda c: F.col("doc_id") > c)) if cuts else F.lit(0)
    dealt = docs.withColumn("part", part.cast("int"))
    order = F.xxhash64("text"), F.col("text")
    # the first row of each range in descending order: no more rows than ranges
    heads = {r.part: r.doc_id for r in dealt.groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()}
    ranges = sorted(heads, reverse=True)
    before = [(heads[p], q) for q, p in zip([ranges[-1], *ranges], ranges)] if ranges else []
    guests = docs.join(F.broadcast(spark.createDataFrame(before, "doc_id long, part int")), "doc_id")
    guests = guests.groupBy("doc_id", "part").agg(F.min(F.struct(order[0].alias("h"), order[1].alias("text"))).alias("t"))
    both = dealt.select("part", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests.select("part", "doc_id", "t.text", F.lit(True).alias("guest")))
    ordered = both.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "guest", F.desc("doc_id"), *order)
    return ordered.mapInArrow(_neighbours, _RESULT).withColumn("doc_id", public_id())
