import random
import re
from collections import Counter

from pyspark.sql import functions as F

from planimetra.llm import lines
from tests.llm.fixtures import awkward, documents, words


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    s = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), min(len(a), len(b)))
    return p + s >= max(len(a), len(b)) - 1


def brute(rows, least=lines.MIN_WORDS):
    places = sorted({((-(2**63) if d is None else d, t or ""), i): None for d, t in rows for i in range(len((t or "").split("\n")))}, key=lambda x: (x[0][0], x[1]))
    seen, gone = [], set()
    for (d, t), i in places:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.split("\n")[i])
        if not w:
            continue
        for (d2, i2), v in seen:
            if (d2, i2) < (d, i) and (v == w or min(len(v), len(w)) >= least and within_one(v, w)):
                gone.add((d, t, i))
                break
        seen.append(((d, i), w))
    out = []
    for d, t in rows:
        key, split = (-(2**63) if d is None else d), (t or "").split("\n")
        kept = [x for i, x in enumerate(split) if (key, t or "", i) not in gone]
        out.append((d, None if t is None else "\n".join(kept), 0 if t is None else len(split), len(split) - len(kept)))
    return Counter(out)


def edited():
    rng = random.Random(5)
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(1, 6)):
            w = words(rng.choice([3, 7, 8, 9, 20]), rng.randint(0, 5))
            for _ in range(rng.randint(0, 2)):
                kind, at = rng.randint(0, 2), rng.randrange(len(w))
                w[at : at + (kind > 0)] = [] if kind == 1 else ["new" + str(rng.randint(0, 3))]
            text.append(rng.choice(["", " ", "\t"]) + " ".join(w))
        rows.append((d, "\n".join(text)))
    return rows


def found(spark, rows):
    out = lines.drop_repeated_lines(documents(spark, rows))
    return Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect())


def test_edited_lines_match_brute_force(spark):
    rows = edited()
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] != 13 and r[0] != 14]
    assert found(spark, rows) == brute(rows)


def test_columns_pass_through(spark):
    more = documents(spark).withColumns({c: F.lit("x") for c in ("line", "h", "gone", "n_lines", "place", "row_key")})
    got = lines.drop_repeated_lines(more)
    assert {"line", "h", "gone", "place", "row_key", "n_lines", "lang"} <= set(got.columns)
    assert got.count() == len(awkward()) and got.filter("line = 'x'").count() == len(awkward())
    assert lines.drop_repeated_lines(documents(spark, [])).count() == 0
