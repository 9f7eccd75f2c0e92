import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from planimetra.llm import syncmers
from tests.llm.fixtures import awkward, documents, words




@pytest.mark.parametrize("parts", [1, 2, 7])
def test_edited_texts_follow_descending_ids(spark, parts):
    rows = [(d, t) for d, t in awkward() if d is not None and d < 17][:17] + [(99, "the first " * 30)]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    got = {r.doc_id: r for r in syncmers.fingerprint_documents(documents(spark, rows), parts).collect()}
    ordered = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].fingerprint == syncmers.fingerprints([t])[0]
        assert got[d].edited_fingerprint == syncmers.fingerprints([edited])[0]
        assert got[d].near_next == syncmers.likeness(got[d].fingerprint, syncmers.fingerprints([n])[0])


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = awkward()
    more = documents(spark, rows).withColumns({"part": F.lit("x"), "guest": F.lit(1)})
    got = syncmers.fingerprint_documents(more).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert syncmers.fingerprint_documents(documents(spark, [])).count() == 0
    one = syncmers.fingerprint_documents(documents(spark, [(3, "alone " * 40)])).collect()
    assert one[0].near_next == 1.0


def test_syncmers_are_context_free_and_closed():
    text = " ".join(words(300, 1))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    _, place, code = syncmers.anchors(points, np.array([0, len(points)]))
    inside = text[400:900]
    points = np.frombuffer(inside.encode("utf-32-le"), np.uint32)
    _, inner, inner_code = syncmers.anchors(points, np.array([0, len(points)]))
    whole = {(p, c) for p, c in zip(place.tolist(), code.tolist()) if 400 <= p <= 900 - syncmers.K}
    assert whole == {(p + 400, c) for p, c in zip(inner.tolist(), inner_code.tolist())}


def test_likeness_follows_the_shared_part():
    base, other = " ".join(words(900, 2)), " ".join(words(900, 3))
    for share in (0.25, 0.5, 0.75):
        cut = int(len(base) * share)
        a, b = syncmers.fingerprints([base, base[:cut] + other[cut : len(base)]])
        assert abs(syncmers.likeness(a, b) - share / (2 - share)) < 0.15
    a, b = syncmers.fingerprints([base, other])
    assert syncmers.likeness(a, b) < 0.02 and syncmers.likeness(a, a) == 1


def test_long_texts_keep_anchors_in_proportion():
    """Two texts of 60,000 words that share 300 words in the middle still have anchors in common, and likeness follows the uncut one."""
    one, other, shared = words(60_000, 4), words(60_000, 5), words(300, 6)
    texts = [" ".join([*x[:30_000], *shared, *x[30_000:]]) for x in (one, other)]
    a, b = syncmers.fingerprints(texts)
    assert len(a.split(" ")) > 50 * syncmers.ANCHORS
    assert 0 < syncmers.likeness(a, b) < 0.02
    edited = " ".join([*one[:15_000], *other[15_000:]])
    got = syncmers.likeness(*syncmers.fingerprints([" ".join(one), edited]))
    share = len(" ".join(one[:15_000]))
    assert abs(got - share / (len(" ".join(one)) + len(edited) - share)) < 0.02
