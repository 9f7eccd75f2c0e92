import re
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from planimetra.llm import audit, queries
from tests.llm.fixtures import awkward, documents

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels):
    """rows: doc_id, text, source; labels: doc_id, quality, toxic. Filters are applied one after another, in every order."""
    docs = []
    for d, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copy = d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in rows)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": copy}
        docs.append((source or "", fails, any(x == d and q == 1 for x, q, _ in labels if x is not None), any(x == d and t == 1 for x, _, t in labels if x is not None)))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                total[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(total[order[step - 1]])
    return out


def made(spark):
    rows = [(d, t, None if i % 5 == 4 else f"s{i % 3}") for i, (d, t) in enumerate(awkward())]
    rows += [(100, "A#1 " * 250, ""), (101, "A#1 " * 250, "s0"), (102, " ".join(f"w{i}" for i in range(300)), "s1"), (103, " ".join(f"w{i}" for i in range(300)), "s1")]
    labels = [(0, 1, 0), (1, 0, 1), (2, None, 1), (40, 1, None), (100, 0, 1), (101, 1, 0), (101, 0, 1), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("words", "mask", "part", "good", "first", "n")})
    return rows, labels, table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))


def test_equals_filters_applied_one_by_one(spark):
    rows, labels, table, known = made(spark)
    got = audit.audit(audit.labelled(audit.failures(table), known))
    assert {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in got.collect()} == brute(rows, labels)


def test_partitions_and_flushes_change_nothing(spark, monkeypatch):
    _, _, table, known = made(spark)
    plain = sorted(map(tuple, audit.audit(audit.labelled(audit.failures(table), known)).collect()))
    monkeypatch.setattr(audit, "PARTS_HELD", 1)
    assert sorted(map(tuple, audit.audit(audit.labelled(audit.failures(table.repartition(5)), known)).collect())) == plain


def test_the_table_of_first_failures():
    orders = audit.Orders(5)
    assert orders.at.shape == (32, 120) and len({tuple(o) for o in orders.filter.tolist()}) == 120
    for mask, order in ((0, 0), (4, 7), (21, 63), (31, 119)):
        steps = [s for s, f in enumerate(orders.filter[order]) if mask >> f & 1]
        assert orders.at[mask, order] == (steps[0] if steps else 5)
        assert np.flatnonzero(orders.late[mask, order]).tolist() == steps[1:]


def test_fewer_filters_and_odd_rows(spark):
    rows = spark.createDataFrame([("p", 1, True, None), (None, 3, None, True), ("p", None, True, True)], "part string, mask int, good boolean, toxic boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost, r.toxic_lost, r.shapley) for r in audit.audit(rows, "XY").collect()}
    assert len(got) == 8
    assert got["p", "XY", 1] == (1, 1, 0, 1, 0, 2) and got["p", "YX", 1] == (2, 0, 0, 0, 0, 0)
    assert got["", "XY", 2] == (0, 0, 1, 0, 0, 1) and got["", "YX", 1] == (0, 1, 0, 0, 1, 1)


def test_no_documents(spark):
    assert audit.audit(audit.labelled(audit.failures(documents(spark, [])), spark.createDataFrame([], "doc_id long, quality int, toxic int"))).count() == 0


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    got = queries.op13_filter_audit(spark, path).toPandas()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL["op13_filter_audit"]).df()
    columns = ["part", "filter_order", "step", *COUNTS]
    pd.testing.assert_frame_equal(got[columns].sort_values(columns[:3], ignore_index=True), want[columns].sort_values(columns[:3], ignore_index=True))
