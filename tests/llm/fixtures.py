"""Small documents with every awkward case, and the schema of the driver's table."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = "abcdefghijklmnopqrstuvwxyzäé"


def words(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def awkward() -> list[tuple]:
    """(doc_id, text): shared passages, copies, repeats inside a text, nulls, empty and long texts, repeated rows."""
    passage, other = words(80, 1), words(60, 2)
    texts: list[str | None] = [
        " ".join(words(100, 3) + passage + words(40, 4)),
        " ".join(words(30, 5) + passage[5:] + words(20, 6)),
        "\n".join(passage),
        " ".join(words(10, 7) + passage[:70] + other + words(9, 8)),
        " ".join(other * 4),
        " ".join(words(3, 9) + other),
        "",
        None,
        "  \t\n ",
        "word " * 300,
        "word " * 200,
        "x" * 1500,
        "é" * 900 + " " + "é" * 300,
        " ".join(words(3000, 10)),
        " ".join(words(3000, 10)[:1500] + ["inserted"] + words(3000, 10)[1500:]),
        "short text",
        "short text",
    ]
    rows = list(enumerate(texts))
    rows += [(2, texts[2]), (40, texts[0]), (41, texts[0]), (None, texts[5]), (None, None)]
    return rows


def documents(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    rows = awkward() if rows is None else rows
    data = [(d, t, "en", f"s{(d or 0) % 3}", len(t or "")) for d, t in rows]
    return spark.createDataFrame(data, SCHEMA)
