from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import test_decontamination, test_lines, test_minhash, test_mixing
from tests.llm.fixtures import awkward, documents

pipeline = pytest.importorskip("corpus_pipeline")


def folder(tmp_path_factory, docs, benchmark):
    path = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{path}/documents.parquet")
    benchmark.write.parquet(f"{path}/benchmark.parquet")
    return path


def stages(spark, path, tmp):
    """Rows after each stage, written and read again in between."""
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], path).write.parquet(f"{tmp}/{name}")
        out.append(spark.read.parquet(f"{tmp}/{name}"))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages_match_brute_force(spark, tmp_path):
    path = "/root/testdata/sf0.001"
    docs, known, lined, single, clean, mixed = stages(spark, path, str(tmp_path))
    assert all(d.columns == docs.columns for d in (known, lined, single, clean))
    letters = {d for d, t in pairs(docs) if any(c.isalpha() for c in t)}
    assert {d for d, _ in pairs(known)} == letters
    assert Counter(pairs(lined)) == Counter((d, t) for d, t, _, _ in test_lines.brute(pairs(known)))
    groups = test_minhash.brute(pairs(lined))
    assert {d for d, _ in pairs(single)} == {d for d, n, lead in groups if n == 0 or d == lead}
    items = [tuple(r) for r in spark.read.parquet(f"{path}/benchmark.parquet").select("item_id", "text").collect()]
    assert {d for d, _ in pairs(clean)} == {d for d, _ in pairs(single)} - test_decontamination.brute(pairs(single), items)
    sizes, taken = defaultdict(int), Counter()
    for r in clean.collect():
        sizes[r.source] += len(r.text.split())
    want = test_mixing.brute_targets(sizes)
    largest = max(len(t.split()) for _, t in pairs(clean))
    for r in mixed.collect():
        taken[r.source] += r.taken
        assert r.copies > 0 and r.taken == r.copies * r.size
    assert all(abs(taken[s] - want[s]) <= largest for s in sizes)
    assert Counter(map(tuple, pipeline.run(spark, path).collect())) == Counter(map(tuple, mixed.collect()))


def test_awkward_rows_go_through_every_stage(spark, tmp_path, tmp_path_factory):
    bench = spark.createDataFrame([(1, None), (2, "short text")], "item_id long, text string")
    docs = documents(spark).withColumns({c: F.lit("x") for c in ("row_key", "score", "copies", "overlap", "n_removed", "kept")})
    path = folder(tmp_path_factory, docs, bench)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, path).count() <= len(awkward())
    out = stages(spark, path, str(tmp_path))
    assert out[1].count() < len(awkward()) and out[-1].count() > 0
    assert {"row_key", "score", "overlap", "kept"} <= set(out[-1].columns)


def test_empty_table(spark, tmp_path, tmp_path_factory):
    bench = spark.createDataFrame([], "item_id long, text string")
    path = folder(tmp_path_factory, documents(spark, []), bench)
    assert stages(spark, path, str(tmp_path))[-1].count() == 0
