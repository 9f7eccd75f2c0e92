"""Substring deduplication by suffix automata of reference shards.

A shard holds the distinct contexts of an anchor (see repeats.py) in order of doc_id. Its suffix automaton is built as
they stream by: each context is first matched against the automaton of all earlier ones, which gives the matching
statistics, and only what they do not hold is added. A broadcast of all automata would grow with the corpus, so each
one lives in the task that its anchor is dealt to and documents visit only shards that share an anchor with them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.llm import arrays, repeats
from planimetra.llm.tables import keyed, public_id

WINDOW = 50
GRAM = 8


class SuffixAutomaton:
    """Of several sequences, added in ascending order of their document; a state keeps the first document that has it."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]

    def _state(self, length: int, link: int, first: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, at: int, symbol: int, old: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[old], self.first[old], dict(self.next[old]))
        self.link[old] = copy
        while at >= 0 and self.next[at].get(symbol) == old:
            self.next[at][symbol] = copy
            at = self.link[at]
        return copy

    def add(self, sequence: list[int], document: int) -> None:
        edges, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            old = edges[last].get(symbol)
            if old is not None:
                last = old if length[old] == length[last] + 1 else self._split(last, symbol, old)
                continue
            new = self._state(length[last] + 1, 0, document, {})
            at = last
            while at >= 0 and symbol not in edges[at]:
                edges[at][symbol] = new
                at = link[at]
            if at >= 0:
                old = edges[at][symbol]
                link[new] = old if length[old] == length[at] + 1 else self._split(at, symbol, old)
            last = new

    def matched(self, sequence: list[int], window: int, before: int) -> list[int]:
        """Starts of windows that a document smaller than before holds, from the matching statistics of the sequence."""
        edges, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        found = []
        for i, symbol in enumerate(sequence):
            while state and symbol not in edges[state]:
                state = link[state]
                size = length[state]
            if symbol in edges[state]:
                state = edges[state][symbol]
                size += 1
            while state and length[link[state]] >= window:
                state = link[state]
                size = length[state]
            if size >= window and first[state] < before:
                found.append(i - window + 1)
        return found


def _runs(starts: list[int]) -> Iterator[tuple[int, int]]:
    begin = previous = None
    for s in starts:
        if begin is None:
            begin = s
        elif s != previous + 1:
            yield begin, previous - begin + 1
            begin = s
        previous = s
    if begin is not None:
        yield begin, previous - begin + 1


def shard_matches(window: int):
    def judge(doc_ids: list[int], contents: list[bytes]) -> Iterator[tuple[int, int, int]]:
        automaton = SuffixAutomaton()
        for i, (doc_id, content) in enumerate(zip(doc_ids, contents, strict=True)):
            sequence = np.frombuffer(content, np.uint32).tolist()
            found = automaton.matched(sequence, window, doc_id)
            yield from ((i, begin, count) for begin, count in _runs(found))
            if len(found) < len(sequence) - window + 1:
                automaton.add(sequence, doc_id)

    return judge


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row_key, start, size) in words: all words covered by a window that a smaller doc_id has too."""
    unit = repeats.Unit(window, min(gram, window), repeats.word_values, np.dtype(np.uint32))
    found = repeats.find(docs, unit, earlier=True)
    return found.whole.unionByName(repeats.anchored(found.contents, shard_matches(window), unit)).unionByName(repeats.hot_spans(found.windows, unit, earlier=True))


_RESULT = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, starts in arrays.chunks(batches):
            begin, end, first = arrays.word_bounds(data, starts)
            gone = repeats.covered(rows, first, len(begin))
            stay = np.flatnonzero(~gone)
            # the kept words with one space after each
            index = arrays.gathered(begin[stay], end[stay] - begin[stay] + 1)
            line = np.append(data, np.uint8(32))[index]
            ends = np.cumsum(end[stay] - begin[stay] + 1)
            line[ends - 1] = 32
            edge = np.concatenate([[0], ends])[np.searchsorted(stay, first)]
            raw = line.tobytes()
            kept = [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[first])
            yield arrays.batch(_RESULT_ARROW, rows.column(0), np.diff(first), removed, pa.array([k.decode() for k in kept] if with_text else [None] * len(kept), pa.string()), [hashlib.sha256(k).hexdigest() for k in kept])

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256 of each row of documents.

    A null text has no words. Rows without doc_id count as before all others and return a null id. Rows that repeat an
    id do not count as earlier than each other. Other columns of documents play no part. An empty table gives none.
    """
    docs = keyed(documents)
    result = repeats.with_spans(docs, spans(docs, window)).mapInArrow(_kept(with_text), _RESULT)
    return result.withColumn("doc_id", public_id())
