"""Suffix-array deduplication by a logarithmic family of indexes.

The distinct contexts of an anchor (see repeats.py) arrive in batches. A batch gets a suffix array, is merge-scanned
against the levels that exist, where equal neighbours are matches of the full length, and becomes a level itself;
levels of equal size merge, so that n batches leave at most log2(n) levels. An anchor with so many contexts that their
windows would fill a task's memory keeps 64-bit hashes of them instead and compares the bytes of those that are equal;
one with more still is split into windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from planimetra.llm import arrays, repeats
from planimetra.llm.substring import _runs
from planimetra.llm.tables import keyed, public_id

WINDOW = 400
GRAM = 48
BATCH_CONTEXTS = 8
#: Contexts of an anchor up to which windows are kept as text, and up to which one task takes them as hashes.
TEXT_CONTEXTS = 768
HASH_CONTEXTS = 20_000


class IndexFamily:
    """Suffix arrays of contexts, cut at the window: suffixes too short to hold one are left out."""

    def __init__(self, window: int):
        self.window = window
        self.levels: list[tuple[int, list[tuple[bytes, int, int]]]] = []
        self.repeated: dict[int, set[int]] = {}

    def _mark(self, ordered: list[tuple[bytes, int, int]]) -> list[tuple[bytes, int, int]]:
        """Marks equal neighbours and gives one entry of each: the others could match nothing that it does not."""
        kept = ordered[:1]
        for entry in ordered[1:]:
            before = kept[-1]
            if entry[0] == before[0]:
                self.repeated.setdefault(before[1], set()).add(before[2])
                self.repeated.setdefault(entry[1], set()).add(entry[2])
            else:
                kept.append(entry)
        return kept

    def add(self, batch: list[tuple[int, bytes]]) -> None:
        array = self._mark(sorted((content[at : at + self.window], number, at) for number, content in batch for at in range(len(content) - self.window + 1)))
        for _, level in self.levels:
            merged = self._mark(sorted(level + array))  # two sorted runs: one linear merge
            if len(merged) < len(level) + len(array):
                known = {entry[0] for entry in level}
                array = [entry for entry in array if entry[0] not in known]
        weight = 1
        while self.levels and self.levels[-1][0] == weight:
            array = sorted(self.levels.pop()[1] + array)
            weight *= 2
        self.levels.append((weight, array))


def family_matches(window: int, batch_contexts: int = BATCH_CONTEXTS, batches: int = 16):
    """Batches of batch_contexts, or of more where an anchor has so many that there would be over batches of them."""

    def judge(doc_ids: list[int], contents: list[bytes]) -> Iterator[tuple[int, int, int]]:
        found = _by_hash(contents, window) if len(contents) > TEXT_CONTEXTS else None
        if found is not None:
            yield from found
            return
        family = IndexFamily(window)
        numbered = list(enumerate(contents))
        step = max(batch_contexts, -(-len(numbered) // batches))
        for at in range(0, len(numbered), step):
            family.add(numbered[at : at + step])
        for number, starts in family.repeated.items():
            yield from ((number, begin, count) for begin, count in _runs(sorted(starts)))

    return judge


def _window_hashes(content: bytes, window: int) -> np.ndarray:
    return arrays.RangeHash(arrays.byte_values(np.frombuffer(content, np.uint8))).grams(window)


def _by_hash(contents: list[bytes], window: int, hashed=_window_hashes) -> list[tuple[int, int, int]] | None:
    """Matches by the hashes of windows, once the bytes of equal ones are seen to be equal; None if some are not."""
    hashes = [hashed(c, window) for c in contents]
    size = np.array([len(h) for h in hashes])
    _, first, place, count = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
    edge = np.concatenate([[0], np.cumsum(size)])
    shift = np.concatenate([[0], np.cumsum([len(c) for c in contents])])[:-1] - edge[:-1]
    begin = (np.repeat(shift.astype(np.int32), size) + np.arange(edge[-1], dtype=np.int32)).astype(np.int32)
    if not _equal_bytes(np.frombuffer(b"".join(contents), np.uint8), begin, begin[first][place], window):
        return None
    repeated = count[place] > 1
    return [(number, start, n) for number, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) for start, n in _runs(np.flatnonzero(repeated[a:b]).tolist())]


def _equal_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, window: int, rows: int = 4096) -> bool:
    """Whether windows at one and other are equal pair by pair. A pair that moves on by one byte from the pair before needs only its last."""
    step = np.arange(window)
    for at in range(0, len(one), rows):
        a, b = one[at : at + rows], other[at : at + rows]
        if (data[a + window - 1] != data[b + window - 1]).any():
            return False
        whole = a != b
        whole[1:] &= (np.diff(a) != 1) | (np.diff(b) != 1)
        if (data[a[whole][:, None] + step] != data[b[whole][:, None] + step]).any():
            return False
    return True


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_key, start, size) in bytes: all bytes covered by a string of the window's length that starts elsewhere too."""
    unit = repeats.Unit(window, min(gram, window), repeats.byte_values, np.dtype(np.uint8))
    found = repeats.find(docs, unit, earlier=False, hot_contexts=HASH_CONTEXTS)
    return found.whole.unionByName(repeats.anchored(found.contents, family_matches(window), unit)).unionByName(repeats.hot_spans(found.windows, unit, earlier=False))


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary, kept_sha256 string"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_bytes", pa.binary()), ("kept_sha256", pa.string())])


def _kept(with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in arrays.chunks(batches):
            gone = repeats.covered(rows, starts, len(data))
            head = gone.copy()
            head[1:] &= ~gone[:-1]
            inner = starts[1:-1][starts[1:-1] < len(data)]
            head[inner] = gone[inner]  # a run never crosses texts
            count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])
            removed = count(gone)
            raw = data[~gone].tobytes()
            edge = np.concatenate([[0], np.cumsum(np.diff(starts) - removed)]).tolist()
            kept = [raw[a:b] for a, b in zip(edge, edge[1:])]
            yield arrays.batch(_RESULT_ARROW, rows.column(0), np.diff(starts), removed, count(head), pa.array(kept if with_bytes else [None] * len(kept), pa.binary()), [hashlib.sha256(k).hexdigest() for k in kept])

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes, kept_sha256 of each row of documents; texts are UTF-8 bytes.

    Every copy goes, the first too. A null text is empty. Rows that repeat an id are places of their own. A null doc_id
    stays null. Other columns play no part. An empty table gives none.
    """
    docs = keyed(documents)
    result = repeats.with_spans(docs, spans(docs, window)).mapInArrow(_kept(with_bytes), _RESULT)
    return result.withColumn("doc_id", public_id())
