import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from planimetra.llm import arrays, language, toxicity
from tests.llm.fixtures import awkward, documents, words

SF = "/root/testdata/sf0.1"


def test_held_out_language_accuracy(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(table).select("doc_id", "lang", "held_out", "lang_pred", "score").collect()
    assert len(rows) == table.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_reads_only_text_outside_the_fold(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(600).cache()
    plain = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(table).collect()}
    other = table.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("same"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other).collect()} == plain


def test_language_learns_from_every_labelled_text(spark):
    """The weights of 300 texts a language are those of plain sums over all of them, however they are dealt."""
    rows = [(i, " ".join(words(20, i))[: 40 + i % 60] + (" und der" if i % 2 else " and the"), "ab"[i % 2], "s", 0) for i in range(760)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    own = table.filter(~language.held_out()).select("text", "lang", F.xxhash64("doc_id", "text").alias("signs")).collect()
    names, weights = language.learned(table.repartition(5))
    x = language.presence(*arrays.flat_bytes(pa.array([r.text for r in own]))).astype(np.float64)
    x /= np.sqrt(x.sum(axis=1))[:, None]
    is_of = np.array([[r.lang == name for name in names] for r in own])
    assert names == ["a", "b"] and is_of.sum(axis=0).min() > 280
    sign = np.array([[(r.signs >> k & 1) * 2 - 1 for k in range(language.LANDMARKS_PER_LANGUAGE)] for r in own])
    marks = np.concatenate([(sign * of[:, None]).T @ x for of in is_of.T])
    marks /= np.linalg.norm(marks, axis=1)[:, None]
    value, vector = np.linalg.eigh(marks @ marks.T)
    root = (vector / np.sqrt(value))[:, value > 1e-6 * value.max()]
    basis = x @ marks.T @ root
    heavy = (is_of / is_of.sum(axis=0)).sum(axis=1)[:, None]
    solved = np.linalg.solve(basis.T @ (heavy * basis) + language.RIDGE / len(own) * np.eye(basis.shape[1]), basis.T @ (heavy * (2.0 * is_of - 1)))
    assert np.abs(x @ weights - x @ marks.T @ root @ solved).max() < 1e-3


def test_awkward_languages(spark):
    rows = [(1, "hello there"), (2, None), (3, ""), (4, "123 !!"), (5, "été"), (None, "hello"), (1, "hello there")]
    more = documents(spark, rows).withColumns({"score": F.lit(1), "_letter": F.lit("x"), "names": F.array(F.lit(1))})
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(more).collect()]
    assert len(got) == 7
    assert all((p == "und") == (d in (2, 3, 4)) for d, p, _ in got)
    unlabelled = documents(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    assert language.identify(documents(spark, [])).count() == 0


def test_presence_is_the_kernel_of_shared_grams():
    texts = ["abcab", "", "Bcx"]
    data, starts = arrays.flat_bytes(pa.array(texts))
    x = language.presence(data, starts)
    grams = [{t.lower()[i : i + n] for n in language.LENGTHS for i in range(len(t) - n + 1)} for t in texts]
    assert (x @ x.T).tolist() == [[len(a & b) for b in grams] for a in grams]


def test_held_out_toxicity(spark):
    table, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in toxicity.score(table, labels).collect()}
    assert len(rows) == table.count()
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    held = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    toxic, ordinary = (np.array([s for s, t in held if t == k]) for k in (1, 0))
    assert (toxic[:, None] > ordinary[None, :]).mean() > 0.94
    assert (toxic >= 0.5).mean() > 0.8 and (ordinary < 0.5).mean() > 0.99
    again = {r.doc_id: r.score for r in toxicity.score(table.repartition(5), labels.repartition(3)).collect()}
    assert all(abs(again[d] - r.score) < 1e-9 for d, r in rows.items())


def test_labels_of_the_fold_are_not_learned(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = {r.doc_id: r.score for r in toxicity.score(table, labels).collect()}
    flipped = labels.withColumn("toxic", F.when(toxicity.fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score(table, flipped).collect()} == plain


def test_shuffle_join_of_labels(spark, monkeypatch):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = {r.doc_id: r.score for r in toxicity.score(table, labels).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_LABELS", 10)
    assert {r.doc_id: r.score for r in toxicity.score(table, labels).collect()} == plain


def test_awkward_toxicity(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, None), (None, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int")
    more = documents(spark).withColumns({"toxic": F.lit("x"), "held_out": F.lit(3)})
    rows = toxicity.score(more, labels).collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.score(documents(spark), none).collect()} == {0}
    assert toxicity.score(documents(spark, []), labels).count() == 0


def test_tables_match_brute_force(spark):
    """Features of texts by plain dictionaries, by lookup and by joins."""
    import math
    import re
    from collections import Counter

    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [(r.doc_id, r.text or "", toxic[r.doc_id]) for r in table.collect() if r.doc_id in toxic][:150]
    split = [["<s>", *re.findall(r"[\w'\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t).replace("_", " "))] for _, t, _ in rows]
    counts = [Counter(), Counter()]
    for words, (_, _, k) in zip(split[:100], rows):
        counts[k].update(zip(words, words[1:]))
    after, before = [Counter(w for _, w in c) for c in counts], [Counter(), Counter()]
    kinds, every = [Counter(h for h, _ in c) for c in counts], Counter(w for _, w in {*counts[0], *counts[1]})
    for c, own in zip(counts, before):
        for (h, _), n in c.items():
            own[h] += n
    shared = lambda w: (every[w] + 0.5) / (sum(every.values()) + 0.5 * len(every) + 0.5)
    low = lambda k, w: (max(after[k][w] - 1, 0) + len(after[k]) * shared(w)) / sum(after[k].values())
    pair = lambda k, h, w: (max(counts[k][h, w] - 1, 0) + (kinds[k][h] + toxicity.PRIOR) * low(k, w)) / (before[k][h] + toxicity.PRIOR)
    clip = lambda x: max(-toxicity.LARGEST_RATIO, min(toxicity.LARGEST_RATIO, x))
    want = {}
    for words, (d, _, _) in zip(split, rows):
        both = [clip(math.log(pair(1, h, w) / pair(0, h, w))) for h, w in zip(words, words[1:])]
        want[d] = (sum(both) / len(both), max(clip(math.log(low(1, w) / low(0, w))) for w in words[1:])) if both else (0.0, 0.0)
    texts = spark.createDataFrame([(d, d, t, k) for d, t, k in rows], "doc_id long, row_key long, text string, toxic int")
    counted = spark.createDataFrame(rows[:100], "doc_id long, text string, toxic int").select("text", "toxic").mapInArrow(toxicity._counted, toxicity._PAIR)
    tables = toxicity.Tables.of(counted.groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))
    for way in (tables._looked_up, tables._joined):
        got = {r.doc_id: (r.mean, r.peak) for r in way(texts).collect()}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for d in want for a, b in zip(got[d], want[d]))


def test_joined_model_gives_the_same_scores(spark, monkeypatch):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = {r.doc_id: r.score for r in toxicity.score(table, labels).collect()}
    monkeypatch.setattr(toxicity, "BROADCAST_MODEL", 10)
    joined = {r.doc_id: r.score for r in toxicity.score(table, labels).collect()}
    assert plain.keys() == joined.keys() and all(abs(joined[d] - x) < 1e-9 for d, x in plain.items())


def test_model_beyond_one_broadcast_shuffles_no_words(spark, monkeypatch):
    """Pairs in blocks give the scores of one table, repeated and empty rows included, without joining the texts' words."""
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    table = table.unionByName(table.limit(20)).unionByName(table.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CASE WHEN doc_id % 2 = 0 THEN '' END AS text", "lang", "source", "n_chars"))
    model = toxicity.fit(table, labels)
    known, pairs = model.tables.words.count() + model.tables.histories.count(), model.tables.pairs.count()
    told = lambda: sorted(((r.doc_id is None, r.doc_id), r.score, r.predicted) for r in toxicity.score(table, labels).collect())
    plain = told()
    monkeypatch.setattr(toxicity, "BROADCAST_MODEL", max(known, pairs // 3))
    assert known + pairs > toxicity.BROADCAST_MODEL
    monkeypatch.setattr(toxicity.Tables, "_joined", None)
    got = told()
    assert len(got) == len(plain) == table.count()
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, plain))
    assert told() == got
