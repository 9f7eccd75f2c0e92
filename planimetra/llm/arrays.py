"""NumPy helpers for tasks: whole Arrow batches of texts as flat arrays, without a Python loop over documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in runs of about this many bytes, which bounds a task's memory.
CHUNK_BYTES = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_WORD_TABLE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and their inverses."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + n // 4, 1 << 20) + 1
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit values, each in constant time."""

    def __init__(self, values: np.ndarray):
        up, self._down = powers(len(values))
        self._sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up[:-1], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._down[start])

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self._sums) - k)
        return mixed((self._sums[k:] - self._sums[:n]) * self._down[:n]) if n else np.zeros(0, _U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values; shorter than x by width - 1."""
    if len(x) < width:
        return x[:0]
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text starts (one more than texts)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about limit bytes of text: rows, bytes, starts."""
    for batch in batches:
        data, starts = flat_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), data[starts[at] : starts[to]], starts[at : to + 1] - starts[at]
            at = to


def letters_table() -> np.ndarray:
    """Bytes of ASCII letters, digits, the apostrophe and everything beyond ASCII."""
    table = np.zeros(256, bool)
    table[128:] = True
    for a, b in ("09", "AZ", "az", "''"):
        table[ord(a) : ord(b) + 1] = True
    return table


def word_bounds(data: np.ndarray, starts: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word of each text (one more than texts). Words are runs without ASCII white space, or of the bytes in table."""
    inside = ~_SPACE[data] if table is None else table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return RangeHash(_WORD_TABLE[data])(begin, end)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _WORD_TABLE[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def owners(starts: np.ndarray) -> np.ndarray:
    """For each element of a flat sequence, the text that it belongs to."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Slices data[starts[i]:starts[i + 1]] as binary values."""
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices start[0]..start[0]+size[0]-1, start[1].., one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
