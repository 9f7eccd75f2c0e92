import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planimetra.llm import minhash
from planimetra.llm.components import components
from tests.llm.fixtures import awkward, documents, words


def sets_of(rows):
    out = []
    for _, t in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute(rows):
    sets, ids = sets_of(rows), [-(2**63) if d is None else d for d, _ in rows]
    lead = {d: d for d in ids}

    def root(d):
        while lead[d] != d:
            d = lead[d]
        return d

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 85 * len(a | sets[j]):
                x, y = sorted((root(ids[i]), root(ids[j])))
                lead[y] = x
    return Counter((d, len(s), root(i)) for (d, _), i, s in zip(rows, ids, sets))


def near_copies():
    rng = random.Random(3)
    rows, n = [], 0
    for g in range(12):
        base = words(150, 100 + g)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = "edit" + str(rng.random())
            rows.append((n := n + 1, " ".join(w)))
    return rows


def found(spark, rows, **kw):
    out = minhash.near_duplicates(documents(spark, rows), **kw).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return Counter((r.doc_id, r.n_shingles, -(2**63) if r.component_id is None else r.component_id) for r in out)


def cloud():
    """Copies of two texts that lie at any distance of each other, most of them linked with few, and a chain of texts."""
    rng, rows = random.Random(4), []
    for g in range(2):
        base = words(120, 300 + g)
        for _ in range(150):
            w = list(base)
            for _ in range(rng.randint(0, 14)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(40))
            rows.append(" ".join(w))
    w = words(200, 310)
    for k in range(40):
        w = w[:]
        w[5 * k % 200] = f"step{k}"
        rows.append(" ".join(w))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("blocks", [(2048, 4_000_000), (7, 9_000)])
@pytest.mark.parametrize("rows", [near_copies(), cloud()], ids=["groups", "cloud"])
def test_links_match_brute_force(spark, rows, blocks):
    assert found(spark, rows, block_rows=blocks[0], block_bytes=blocks[1]) == brute(rows)


def test_awkward_rows(spark):
    rows = awkward()
    assert found(spark, rows) == brute(rows)


def test_driver_rows(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    more = documents(spark).withColumns({c: F.lit("x") for c in ("key", "n", "row_key", "values", "component_id")})
    assert minhash.near_duplicates(more).count() == len(awkward())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(51)}, **{100 + i: 100 for i in range(60)}}


def test_components_of_random_graphs(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1700)]
    lead = list(range(3000))

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        lead[y] = x
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(13)).collect()
    assert len(got) == len(nodes) and dict(map(tuple, got)) == {x: root(x) for x in nodes}


def test_pairs_from_80_to_below_85(spark):
    rng, rows, between = random.Random(12), [], 0
    for i in range(200):
        w = words(150, 5000 + i)
        near = list(w)
        for k in rng.sample(range(10, 140), 3):
            near[k] = "changed" + str(k)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(near))]
        a, b = sets_of(rows[-2:])
        between += 0.8 <= len(a & b) / len(a | b) < 0.85
    want = {d for i in range(200) for d in (2 * i, 2 * i + 1) if d % 2 == 0 or not similar(rows[2 * i : 2 * i + 2], 80)}
    assert between > 50
    assert {r.doc_id for r in minhash.keep_first(documents(spark, rows), 80).collect()} == want
    stage = pytest.importorskip("corpus_pipeline").near_dedup
    assert {r.doc_id for r in stage(spark, documents(spark, rows), "").collect()} == want
    assert found(spark, rows) == brute(rows)


def similar(rows, percent):
    a, b = sets_of(rows)
    return 100 * len(a & b) >= percent * len(a | b)


def test_bands_follow_the_threshold():
    assert [(b.half, b.least_equal) for b in map(minhash.Bands, (85, 80))] == [(10, 23), (13, 29)]
