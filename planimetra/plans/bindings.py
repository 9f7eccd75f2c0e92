"""Inputs of the operators, derived from the driver's tables, in SQL that Spark and DuckDB both read.

The captures that the operators are meant for are not at hand, so these views only exercise their logic. Where the two
engines differ, a name in braces is filled in: {e0}, {e1}.. are embedding elements, {ts} is a timestamp in seconds.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# view: (table, columns)
VIEWS: dict[str, tuple[str, str]] = {
    "points": (
        "embeddings",
        "vec_id AS point_id, label AS view_id, CAST({e0} AS DOUBLE) * 10 AS x, CAST({e1} AS DOUBLE) * 10 AS y, CAST({e2} AS DOUBLE) * 10 AS z, "
        "vec_id % 3 AS confidence, CAST({e3} AS DOUBLE) AS r, CAST({e4} AS DOUBLE) AS g, CAST({e5} AS DOUBLE) AS b",
    ),
    "poses": (
        "events",
        "user_id AS trajectory_id, event_id, {ts} AS ts_s, value / 25 AS x, 0.0 AS y, ({ts} / 14400) % 6 AS z, "
        "0.0 AS qx, sin((event_id % 360) * 1.0137 / 114.59155902616465) AS qy, 0.0 AS qz, cos((event_id % 360) * 1.0137 / 114.59155902616465) AS qw",
    ),
    "measurements": (
        "lineitem",
        "l_orderkey AS room_id, l_linenumber AS entity, l_partkey AS part, l_suppkey AS supp, CASE l_returnflag WHEN 'A' THEN 'wall_length' WHEN 'N' THEN 'opening_width' ELSE 'ceiling_height' END AS type, "
        "l_extendedprice * (1 - l_discount) / 10000 AS predicted, l_extendedprice / 10000 AS reference, "
        "l_extendedprice * (1 - l_discount - l_tax) / 10000 AS lower, l_extendedprice * (1 - l_discount + l_tax) / 10000 AS upper, l_extendedprice * (1.01 + l_tax - 0.04) / 10000 AS incumbent",
    ),
    "walls": (
        "supplier",
        "s_suppkey AS wall_id, s_nationkey AS capture_id, cos(s_suppkey * 0.7) AS a, sin(s_suppkey * 0.7) * 0.2 AS b, sin(s_suppkey * 0.7) AS c, s_acctbal / 2000 AS d, "
        "(s_suppkey % 40) / 200.0 AS rmse, (s_suppkey % 50) / 50.0 AS confidence, s_suppkey * 97 % 9000 AS inliers, 0.5 + (s_suppkey % 25) / 10.0 AS height, "
        "0.2 + (s_suppkey % 17) / 8.0 AS span, (s_suppkey % 13) / 20.0 AS floor_gap",
    ),
    "rooms": (
        "orders",
        "o_orderkey AS room_id, o_custkey AS property_id, (o_orderkey * 3 % 40) * 1.0 AS x0, (o_orderkey * 7 % 40) * 1.0 AS z0, 2.0 + o_orderkey % 5 AS w, 2.0 + o_custkey % 4 AS h",
    ),
    "openings": (
        "customer",
        "c_custkey AS opening_id, c_nationkey AS capture_id, (c_custkey * 13 % 97) / 10.0 AS x, (c_custkey * 29 % 89) / 10.0 AS z, 0.3 + (c_custkey % 30) / 10.0 AS width, 0.2 + (c_custkey % 70) / 100.0 AS score",
    ),
    "observations": (
        "events",
        "event_id AS observation_id, user_id AS capture_id, user_id * 7 + event_id % 7 AS surface_id, event_type AS damage_class, value AS u, (event_id * 37 % 101) / 50.0 AS v, "
        "0.050123 + (event_id % 90) / 100.0 AS confidence, (event_id * 11 % 85) * 1.0 AS angle, 0.0137 + (event_id % 600) / 2.0 AS sharpness, 0.60017 + (event_id * 17 % 120) / 100.0 AS width, (event_id * 13 % 60) / 10.0 AS distance",
    ),
    "detections": ("events", "event_id AS detection_id, event_id % 24 AS prompt, value AS x1, event_id % 400 * 1.0 AS y1, value + 40 + event_id % 80 AS x2, event_id % 400 + 90.0 AS y2"),
    "pairs": ("orders", "o_orderkey AS pair, o_orderkey * 31 % 997 AS a, o_custkey * 17 % 997 AS b, o_orderkey % 40 AS inliers, o_orderkey % 8 AS config"),
}

_SPARK = {f"e{i}": f"embedding[{i}]" for i in range(8)} | {"ts": "unix_micros(CAST(ts AS TIMESTAMP)) / 1000000"}
_DUCK = {f"e{i}": f"embedding[{i + 1}]" for i in range(8)} | {"ts": "epoch_us(ts) / 1000000"}


def _doubles(text: str) -> str:
    """Decimal literals as doubles, as which both engines read an exponent."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1E0", text)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, named = VIEWS[name]
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return source.selectExpr(*columns(_doubles(named.format(**_SPARK))))


def columns(listed: str) -> list[str]:
    """Columns at commas outside parentheses."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[start:i].strip())
            start = i + 1
    return [*out, listed[start:].strip()]


def sql(query: str, *names: str) -> str:
    """query behind the views that it names, for DuckDB."""
    ctes = ", ".join(f"{n} AS (SELECT {_doubles(VIEWS[n][1].format(**_DUCK))} FROM {VIEWS[n][0]})" for n in names)
    body = _doubles(query.strip())
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"
