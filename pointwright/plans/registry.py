"""Every query of the point-cloud operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# Tables of points as DuckDB SQL (see pointwright.sources.tables).
CLOUD = """cloud AS (SELECT 'Area_' || (o_orderkey % 6 + 1) AS cloud, o_orderkey AS pid,
 (CAST(round(o_totalprice * 100) AS BIGINT) % 5000) / CAST(1000 AS DOUBLE) AS x, (o_orderkey * 7919 % 6000) / CAST(1000 AS DOUBLE) AS y, (o_orderkey * 104729 % 3000) / CAST(1000 AS DOUBLE) AS z,
 o_orderkey * 31 % 256 AS r, o_orderkey * 57 % 256 AS g, o_custkey * 13 % 256 AS b, o_custkey % 13 AS label, (o_orderkey * 7 + o_custkey) % 13 AS pred FROM orders)"""
VECTOR = """vec AS (SELECT 'all' AS cloud, vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z,
 CAST(embedding[4] AS DOUBLE) AS r, CAST(embedding[5] AS DOUBLE) AS g, CAST(embedding[6] AS DOUBLE) AS b, CAST(label AS BIGINT) AS label FROM embeddings)"""
PRED = "pt AS (SELECT l_suppkey % 13 AS truth, l_partkey % 13 AS pred, l_tax > 0 AS mask FROM lineitem)"
EVENTS = """ev AS (SELECT CAST(user_id % 3 AS VARCHAR) AS cloud, event_id AS pid, (event_id * 7919) % 4000 / CAST(1000 AS DOUBLE) AS x, (event_id * 104729) % 4000 / CAST(1000 AS DOUBLE) AS y,
 (event_id * 1299709) % 2000 / CAST(1000 AS DOUBLE) AS z, value AS intensity FROM events)"""


def squared(a: str, b: str, columns: str = "xyz") -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in columns)


def key(c: str) -> str:
    return f"(({c} * 1103515245 + 12345) % 2147483648)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


from . import cloud_queries, graph_queries, metric_queries, source_queries  # noqa: E402, F401  (they register)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all points from a fifth of them (kNN, softmax weights, argmax), and their IoU."""
    return QUERIES["flagship_interpolated_iou"](spark, sf_dir)
