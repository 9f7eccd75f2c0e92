"""Connected components of an edge table: partitions merge their own edges, alternating stars join the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimetra.llm.tables import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: links each larger neighbour to the least one. Else: each smaller neighbour, and the node itself."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if large:
        both = both.union(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links each node of a partition to the least one that its edges there reach: a forest of stars, never more rows."""
    lead: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while lead[top] != top:
            top = lead[top]
        while lead[x] != top:
            lead[x], x = top, lead[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lead.setdefault(a, a)
            lead.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                lead[max(x, y)] = min(x, y)
    pairs = [(x, root(x)) for x in list(lead)]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the least node that can be reached.

    Partitions of edges, dealt by the larger node, are first merged on their own. Then each round writes its edges once; its cost is
    linear in the edges, whose number falls to one a node, and it ends as soon as they are stars.
    """
    ordered = edges.filter("a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))
    edges = stored(ordered.repartition("a").mapInArrow(_merged, "a long, b long"), "stars")
    while True:
        several = edges.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low != high")
        inner = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        if several.select("a").unionByName(inner).limit(1).isEmpty():
            nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
            return nodes.union(edges.select("b", "b").distinct())
        edges = stored(_star(_star(edges, True), False).mapInArrow(_merged, "a long, b long"), "stars")
