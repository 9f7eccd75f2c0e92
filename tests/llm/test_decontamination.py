import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from planimetra.llm import arrays, decontamination as dc
from tests.llm.fixtures import awkward, documents, words


def code_of(text):
    data, starts = arrays.flat_bytes(pa.array([text or ""]))
    return dc.words(data, starts)[0]


def brute(rows, items):
    """Which documents match some item, with every window compared to every piece."""
    query = dc.queries(items, dc.Latent(None, np.zeros((1 << dc.TERM_BITS, 2), "float32")))
    out = set()
    for d, t in rows:
        code = code_of(t).tolist()
        for width in dc.WINDOWS:
            for at in range(0, len(code), width // 2):
                low, high = max(0, at - dc.BESIDE), at + width + dc.BESIDE
                if any(dc.verdict(query, k, code[low:high], code[max(0, low - dc.BESIDE) : high + 3 * dc.BESIDE]) for k in query.of_window(width)):
                    out.add(d)
    return out


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert dc.common(dc.mask_of(a), len(a), b) == slow_common(a, b)


def test_driver_rows_match_brute_force(spark):
    table, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = {r.doc_id for r in dc.flag(table, bench).collect() if r.contaminated}
    assert got == brute(rows, items) and len(got) >= 26


def test_paraphrases_and_clean_texts(spark):
    rng = random.Random(2)
    items = [(i, " ".join(words(20, 50 + i)) + ". " + " ".join(words(6, 90 + i)) + ".") for i in range(30)]
    rows = []
    for i, (_, text) in enumerate(items):
        w = text.split()
        for k in rng.sample(range(len(w)), 5):
            w[k] = "changed"
        rows.append((i, " ".join(words(40 + i, 200 + i) + w + words(70, 300 + i))))
    rows += [(100 + i, " ".join(words(150, 400 + i))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_id for r in dc.flag(documents(spark, rows), bench).collect() if r.contaminated}
    assert got == {i: i for i in range(30)}


def test_blocks_of_items_awkward_rows_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(dc, "QUERY_BLOCK", 2)
    items = [(1, None), (2, ""), (3, "short text"), (None, " ".join(words(60, 2)[:40])), (5, "word"), (3, "short text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = documents(spark).withColumns({"overlap": F.lit("x"), "term": F.lit(1)})
    got = dc.flag(more, bench).collect()
    assert len(got) == len(awkward())
    hit = {r.doc_id for r in got if r.contaminated}
    assert {15, 16, 9, 10, 3, 4, 5, None} >= hit >= {15, 16, 9, 10}
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in dc.flag(documents(spark), none).collect())
    assert dc.flag(documents(spark, []), bench).count() == 0


def test_items_inside_other_words_are_found(spark):
    items = [(1, None), (3, "short text"), (None, " ".join(words(60, 2)[:40])), (5, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    hit = {r.doc_id for r in dc.flag(documents(spark), bench).collect() if r.contaminated}
    assert hit == {15, 16, 9, 10, 3, 4, 5, None}


def test_short_items_and_loose_paraphrases_match_brute_force(spark):
    """Passages of 8 to 48 words of other texts, whole or with 50, 60 or 70% of the words, inside documents."""
    texts = [r.text.split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    texts = [t for t in texts if len(t) > 150]
    rng, items, rows = random.Random(4), [], []
    for i in range(140):
        n, kept = (8, 10, 12, 16, 24, 32, 48)[i % 7], (1, 0.5, 0.6, 0.7)[i // 7 % 4]
        at = rng.randrange(len(texts[i]) - n - 10)
        item = texts[i][at : at + n]
        copy, answer = list(item), texts[i][at + n : at + n + 6]
        for k in rng.sample(range(n), round(n * (1 - kept))):
            copy[k] = rng.choice(texts[-1 - k])
        items.append((i, " ".join(item) + ". " + " ".join(answer) if kept < 1 else " ".join(item)))
        host = texts[(i + 150) % len(texts)]
        cut = rng.randrange(len(host))
        rows.append((i, " ".join(host[:cut] + copy + (answer if kept < 1 else []) + host[cut:])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id for r in dc.flag(documents(spark, rows), bench).collect() if r.contaminated}
    want = brute(rows, items)
    assert got <= want and len(want) > 90 and len(got) / len(want) > 0.97


def test_the_cosine_alone_chooses_candidates(spark, monkeypatch):
    table, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    latent = dc.fit(table, bench)
    text = " ".join(words(50, 1)) + " " + items[0][1] + " " + " ".join(words(50, 2))
    data, starts = arrays.flat_bytes(pa.array([text]))
    query = dc.queries(items, latent)
    found = dc.matches(data, starts, latent, query)
    assert found[0][1] == 1 and query.items[found[0][0]] == items[0][0]
    turned = dc.Latent(latent.idf, np.random.default_rng(1).permutation(latent.rows))  # a basis that knows nothing
    assert dc.matches(data, starts, turned, query) == [(-1, 0.0)]
    monkeypatch.setattr(dc, "COSINE", 9.0)
    assert dc.matches(data, starts, latent, query) == [(-1, 0.0)]


def test_basis_holds_every_item(spark, monkeypatch):
    monkeypatch.setattr(dc, "SAMPLE_PASSAGES", 4)
    items = [(i, " ".join(words(20, 7000 + i))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, " ".join(words(60, 8000 + i))) for i in range(30)]
    vectors = dc.queries(items, dc.fit(documents(spark, rows), bench)).vectors
    assert ((vectors @ vectors.T).diagonal() > 0.99).all() and abs(vectors @ vectors.T - np.eye(40)).max() < 0.9


def test_basis_is_fitted_on_all_passages(spark, monkeypatch):
    """The basis holds as much of all passages as the best one of its rank, whatever the number of passages that are multiplied at once."""
    monkeypatch.setattr(dc, "SAMPLE_PASSAGES", 4)
    topics = [words(12, 600 + i) for i in range(12)]
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(topics[i % 12], k=96))) for i in range(120)]
    items = [(0, " ".join(words(20, 7)))]
    latent = dc.fit(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), rank=13)
    passages = [w[at : at + dc.BLOCK] for w in (dc.terms_of(code_of(t)) for _, t in rows) for at in range(0, len(w), dc.BLOCK)]
    table = np.zeros((len(passages), 1 << dc.TERM_BITS))
    for i, w in enumerate(passages):
        np.add.at(table[i], w, latent.idf[w])
    table /= np.linalg.norm(table, axis=1)[:, None]
    basis = np.divide(latent.rows, latent.idf[:, None], out=np.zeros_like(latent.rows), where=latent.idf[:, None] > 0)
    best = np.linalg.svd(table, compute_uv=False)[:12]
    assert len(passages) == 360 and ((table @ basis) ** 2).sum() > 0.98 * (best**2).sum()


def test_products_match_dense_ones():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 33, 300)
    term = np.where(rng.random(size.sum()) < 0.3, 5, rng.integers(0, 3000, size.sum()))
    held = type("Held", (), {"value": rng.random(1 << dc.TERM_BITS, np.float32) + 1})
    batch = pa.RecordBatch.from_arrays([pa.array([term.astype(np.int16).tobytes()]), pa.array([size.astype(np.uint8).tobytes()]), pa.array([True])], names=["terms", "sizes", "own"])
    table = np.zeros((300, 1 << dc.TERM_BITS))
    np.add.at(table, (np.repeat(np.arange(300), size), term), held.value[term])
    table *= 1.5 / np.linalg.norm(table, axis=1)[:, None]
    want = table.T @ (table @ dc.random_basis(9))
    for most in (7, 1000):
        (out,) = dc._multiplied(held, None, 9, most, 1.5)(iter([batch]))
        got = np.zeros_like(want)
        got[out.column(0).to_numpy()] = [np.frombuffer(x, np.float32) for x in out.column(1).to_pylist()]
        assert abs(got - want).max() < 1e-4 * abs(want).max()
