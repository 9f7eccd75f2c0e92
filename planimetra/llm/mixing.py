"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target asks for a fractional number of copies of each of its documents. The whole part is taken; of the
fractions, pairs of documents pass words to each other at random until one holds none or all of its own, so a source's
sum never changes and each document's expectation holds. Leaves of a reduction tree do this for a hash bucket of a source
each and leave at most one fractional document; the levels above pair those until one a source is left to round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planimetra.llm.tables import small_batches, stored

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows of a leaf, all sources together, on average; and children of a node.
LEAF_ROWS = 5_000
FAN = 16

_ROW = "doc_id long, row_key long, source string, size long, source_size long, target double, base int, mass double, node long, done boolean"
_ROW_ARROW = pa.schema([("doc_id", pa.int64()), ("row_key", pa.int64()), ("source", pa.string()), ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()), ("base", pa.int32()), ("mass", pa.float64()), ("node", pa.int64()), ("done", pa.bool_())])
_MASK = 2**64 - 1


def uniform(key: int, level: int) -> float:
    """A number in [0, 1) that only its arguments decide."""
    x = (key * 0x9E3779B97F4A7C15 + (level + 1) * 0xD1B54A32D192ED03) & _MASK
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ x >> shift) * factor) & _MASK
    return ((x ^ x >> 31) >> 11) / 2**53


def transfer(mass: float, size: int, other: float, other_size: int, u: float) -> tuple[float, float]:
    """Words of two documents after a random transfer that leaves one with none or all of its own."""
    up, down = min(size - mass, other), min(mass, other_size - other)
    if u * (up + down) < down:
        first, second = mass + up, other - up
        return (float(size), max(second, 0.0)) if up == size - mass else (min(first, float(size)), 0.0)
    first, second = mass - down, other + down
    return (0.0, min(second, float(other_size))) if down == mass else (max(first, 0.0), float(other_size))


def _rounded(level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held is not None and (held["source"], held["node"]) != (row["source"], row["node"]):
                    out.append(_finish(held, level, last))
                    held = None
                if row["done"]:
                    out.append(row)
                elif held is None:
                    held = row
                else:
                    u = uniform(row["row_key"] ^ held["row_key"], level)
                    held["mass"], row["mass"] = transfer(held["mass"], held["size"], row["mass"], row["size"], u)
                    ended = [r for r in (held, row) if r["mass"] in (0.0, r["size"])]
                    for r in ended:
                        r["done"] = True
                        out.append(r)
                    held = next((r for r in (held, row) if not r["done"]), None)
            yield pa.RecordBatch.from_pylist(out, schema=_ROW_ARROW)
        if held is not None:
            yield pa.RecordBatch.from_pylist([_finish(held, level, last)], schema=_ROW_ARROW)

    return run


def _finish(row: dict, level: int, last: bool) -> dict:
    if last:
        row["mass"] = float(row["size"]) if uniform(row["row_key"], level + 64) * row["size"] < row["mass"] else 0.0
        row["done"] = True
    return row


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of each source of sizes (source, size), one row a source.

    Sources in code-point order, null last, weigh WEIGHTS in turn. What lies above MOST_COPIES times a source's size is
    shared by weight among the others until none is above: with sources in order of cap by weight, that level is the
    largest of (words left) / (weights left). The windows take one row a source, not the documents.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")).cast("double")
    table = table.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_COPIES))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - before) / left
    table = table.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return table.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def decide(documents: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, row_key, size, source, source_size, target, copies, taken of each row of documents.

    A null text has no words. A null source is a source. Rows that repeat another are documents of their own. Only
    doc_id, text and source decide, so reruns agree whatever the partitions. Without any words all is 0.
    """
    spark = documents.sparkSession
    small_batches(spark)
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rows = documents.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, F.coalesce("text", F.lit(""))).alias("row_key"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    rows = stored(rows, "sizes")
    leaves = max(1, -(-rows.count() // leaf_rows))
    wanted = targets(rows)
    share = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    joined = rows.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("base", F.floor(share).cast("int"))
    mass = (share - F.col("base")) * F.col("size")
    level_rows = joined.select("doc_id", "row_key", "source", "size", "source_size", "target", "base", mass.alias("mass"), F.pmod(F.xxhash64("row_key", F.lit(2)), F.lit(leaves)).cast("long").alias("node"), (mass <= 0).alias("done"))
    decided, level = [], 0
    while True:
        dealt = level_rows.repartition(F.col("source"), F.col("node")).sortWithinPartitions("source", "node", F.xxhash64("row_key", F.lit(level)), "doc_id", "size")
        rounded = stored(dealt.mapInArrow(_rounded(level, leaves == 1), _ROW), "rounded")
        decided.append(rounded.filter("done"))
        if leaves == 1:
            break
        leaves = -(-leaves // FAN)
        level += 1
        level_rows = rounded.filter("not done").withColumn("node", F.floor(F.col("node") / FAN))
    every = decided[0]
    for part in decided[1:]:
        every = every.unionByName(part)
    copies = F.col("base") + F.when((F.col("mass") > 0) & (F.col("size") > 0), 1).otherwise(0)
    return every.select("doc_id", "row_key", "size", "source", "source_size", "target", copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mix(documents: DataFrame) -> DataFrame:
    """documents with size, source_size, target, copies and taken added in place of columns of these names."""
    new = ["size", "source_size", "target", "copies", "taken"]
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    names = [c for c in documents.columns if c not in new]
    rows = documents.select(*names).withColumns({"_doc": doc_id, "_row": F.xxhash64(doc_id, F.coalesce("text", F.lit(""))), "_source": F.col("source").cast("string")})
    # rows that repeat a document and its source take the decisions on them in turn
    turn = lambda by: F.row_number().over(Window.partitionBy("_doc", "_row").orderBy("_source", *by))
    rows = rows.withColumn("_turn", turn([]))
    made = decide(documents).select(F.col("doc_id").alias("_doc"), F.col("row_key").alias("_row"), F.col("source").alias("_source"), *new)
    made = made.withColumn("_turn", turn(["copies"])).drop("_source")
    return rows.join(made, ["_doc", "_row", "_turn"]).select(*names, *new)
