import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from planimetra.llm import mixing
from tests.llm.fixtures import SCHEMA, awkward, documents


def brute_targets(sizes: dict):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3 * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if target[s] > 3 * sizes[s] + 1e-9}
        if not above:
            return target
        capped |= above


def corpus(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        source = rng.choice(["a"] * 10 + ["b", "c", "é", "Z", None, "tiny"])
        rows.append((d, " ".join(["w"] * (rng.randint(0, 3) if source == "tiny" else rng.choice([0, 5, 30, 200, 1000]))), "en", source, 0))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("leaf_rows", [mixing.LEAF_ROWS, 20])
def test_targets_and_taken_words(spark, leaf_rows):
    rows, table = corpus(spark)
    got = mixing.decide(table, leaf_rows).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        assert r.size == len(rows[r.doc_id][1].split()) and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_reruns_and_partitions_agree(spark):
    _, table = corpus(spark, 800)
    one = {r.doc_id: r.taken for r in mixing.decide(table, 50).collect()}
    assert {r.doc_id: r.taken for r in mixing.decide(table.repartition(7), 50).collect()} == one


def test_expected_copies_hold():
    total, n = 0.0, 20000
    for k in range(n):
        mass, other = mixing.transfer(3.0, 10, 4.0, 9, mixing.uniform(k, 0))
        assert abs(mass + other - 7) < 1e-9 and (mass in (0.0, 10.0) or other in (0.0, 9.0))
        total += mass
    assert abs(total / n - 3.0) < 0.1


def test_awkward_rows(spark):
    more = documents(spark).withColumns({c: F.lit("x") for c in ("node", "mass", "size", "taken", "row_key")})
    got = mixing.mix(more)
    assert got.count() == len(awkward()) and {"node", "mass", "row_key", "lang"} <= set(got.columns)
    assert mixing.mix(documents(spark, [])).count() == 0
    assert [r.taken for r in mixing.decide(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]
