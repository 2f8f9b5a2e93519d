"""Graphs over the test tables. Two kinds of ids are told apart by parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.running import with_next
from graphloom.model import Graph

#: Name: (table, src, dst, value, condition) as SQL that Spark and DuckDB both read.
DEFINITIONS = {
    "deep": ("lineitem", "2 * l_orderkey", "2 * l_partkey + 1", None, "l_quantity >= 46"),
    "small": ("lineitem", "2 * l_orderkey", "2 * l_partkey + 1", None, "l_quantity >= 49.5"),
    "dense": ("lineitem", "2 * l_partkey", "2 * l_suppkey + 1", None, "true"),
    "star": ("orders", "2 * o_custkey", "2 * o_orderkey + 1", None, "true"),
    "raw": ("lineitem", "l_orderkey", "l_partkey", None, "l_quantity >= 48"),
}


def edges_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "seq":
        # one order over all events, sorted a minute at a time
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
        ahead = with_next(events, ("ts", "event_id"), F.date_trunc("minute", "ts"), "user_id", "dst")
        return ahead.select(F.col("user_id").alias("src"), "dst", "value").where("dst is not null")
    table, src, dst, value, condition = DEFINITIONS[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition)
    return rows.selectExpr(f"{src} AS src", f"{dst} AS dst", f"CAST({value or 0} AS DOUBLE) AS value")


def graph_of(spark: SparkSession, sf_dir: str, name: str, dense: bool = True) -> Graph:
    return Graph(edges_of(spark, sf_dir, name), dense)


def edges_sql(name: str) -> str:
    """The same edges in SQL."""
    if name == "seq":
        return "SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, value FROM events) WHERE dst IS NOT NULL"
    table, src, dst, value, condition = DEFINITIONS[name]
    return f"SELECT CAST({src} AS BIGINT) AS src, CAST({dst} AS BIGINT) AS dst, CAST({value or 0} AS DOUBLE) AS value FROM {table} WHERE {condition}"
