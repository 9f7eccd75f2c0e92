import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planimetra.llm import arrays, repeats, substring, suffixes
from tests.llm.fixtures import awkward, documents


def brute_words(rows, w=50):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    ids = [-(2**63) if d is None else d for d, _ in rows]
    least = {}
    for d, ws in zip(ids, split):
        for i in range(len(ws) - w + 1):
            key = tuple(ws[i : i + w])
            least[key] = min(least.get(key, d), d)
    out = []
    for (d, _), i, ws in zip(rows, ids, split):
        gone = set()
        for k in range(len(ws) - w + 1):
            if least[tuple(ws[k : k + w])] < i:
                gone.update(range(k, k + w))
        kept = " ".join(x for j, x in enumerate(ws) if j not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def brute_bytes(rows, w=400):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + w] for b in raw for i in range(len(b) - w + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if seen[b[i : i + w]] > 1:
                gone[i : i + w] = b"\1" * w
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [repeats.HOT_CONTEXTS, 1])
def test_words_match_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats.find, "__defaults__", (hot,))
    found = substring.remove_repeats(documents(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == brute_words(awkward())


@pytest.mark.parametrize("text, hot", [(768, 20_000), (1, 20_000), (768, 1)])
def test_bytes_match_brute_force(spark, monkeypatch, text, hot):
    monkeypatch.setattr(suffixes, "TEXT_CONTEXTS", text)
    monkeypatch.setattr(suffixes, "HASH_CONTEXTS", hot)
    found = suffixes.remove_repeats(documents(spark)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == brute_bytes(awkward())


def test_driver_rows_match_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    found = suffixes.remove_repeats(table, with_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == brute_bytes(rows)
    found = substring.remove_repeats(table, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, found)) == brute_words(rows)


def test_empty_table_and_clashing_columns(spark):
    empty = documents(spark, [])
    assert substring.remove_repeats(empty).count() == 0
    assert suffixes.remove_repeats(empty).count() == 0
    more = documents(spark).withColumns({c: F.lit("x") for c in ("anchor", "start", "row_key", "spans", "context")})
    assert substring.remove_repeats(more).count() == len(awkward())
    assert suffixes.remove_repeats(more).count() == len(awkward())


def test_texts_are_kept_whole(spark):
    rows = {r.doc_id: r for r in substring.remove_repeats(documents(spark, [(1, "a  b\tc"), (2, None)])).collect()}
    assert rows[1].kept_text == "a b c" and rows[2].kept_text == ""


def test_very_long_texts_choose_the_same_anchors():
    data, starts = arrays.flat_bytes(pa.array([t or "" for _, t in awkward()]))
    for values, first, window, gram in ((*repeats.word_values(data, starts), 50, 8), (*repeats.byte_values(data, starts), 400, 48)):
        short, long = (repeats.contexts_of(values, first, window, gram, most) for most in (1 << 20, 10))
        assert all((a == b).all() for a, b in zip(short, long, strict=True)) and len(short[0])


def test_equal_hashes_of_unequal_bytes_are_noticed(monkeypatch):
    """Windows matched by hash are those that the suffix arrays match, whatever the hash is worth."""
    base = bytes(range(97, 123)) * 3
    contents = [base[:40], b"__" + base[5:50], b"-" * 45, base[60:78] + base[:30], bytes(range(200, 250))]
    wanted = sorted(suffixes.family_matches(20)([0] * 5, contents))
    assert wanted and sorted(suffixes._by_hash(contents, 20)) == wanted
    weak = lambda content, window: np.array([content[i] % 3 for i in range(len(content) - window + 1)], np.uint64)
    assert suffixes._by_hash(contents, 20, weak) is None
    monkeypatch.setattr(suffixes, "TEXT_CONTEXTS", 2)
    monkeypatch.setattr(suffixes, "_by_hash", lambda c, w: None)
    assert sorted(suffixes.family_matches(20)([0] * 5, contents)) == wanted
