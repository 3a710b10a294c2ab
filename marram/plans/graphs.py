"""Graphs derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marram.operators.graph import simple_edges
from marram.sources.shared import table


def co_ordered_parts(spark: SparkSession, sf_dir: str, least_quantity: float = 40) -> DataFrame:
    """Parts that share an order in lines of at least this quantity. An order has few lines, so the join on it stays narrow."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least_quantity).select("l_orderkey", F.col("l_partkey").alias("part"))
    pairs = lines.withColumnRenamed("part", "u").join(lines.withColumnRenamed("part", "v"), "l_orderkey").where("u < v")
    return simple_edges(pairs)


def co_shipped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, u, v): parts that share an order in lines of the same return flag and status, which name the network."""
    lines = _lines_by_status(spark, sf_dir, "l_orderkey")
    return lines.withColumnRenamed("part", "u").join(lines.withColumnRenamed("part", "v"), ["l_orderkey", "graph"]).where("u < v").select("graph", "u", "v")


def shipped_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph, node): all parts in lines of each return flag and status."""
    return _lines_by_status(spark, sf_dir).select("graph", F.col("part").alias("node")).distinct()


def _lines_by_status(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*keys, F.concat("l_returnflag", "l_linestatus").alias("graph"), F.col("l_partkey").alias("part"))


def users_in_step(spark: SparkSession, sf_dir: str, seconds: int = 120) -> DataFrame:
    """Users with an event of one type within so many seconds: events meet in their own time slot and the next, so it is an equi-join."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    width = seconds * 1_000_000
    slot = F.floor(F.col("us") / width)
    a = e.select("event_type", F.col("user_id").alias("u"), F.col("us").alias("ua"), slot.alias("slot"))
    b = e.select("event_type", F.col("user_id").alias("v"), F.col("us").alias("ub"), F.explode(F.array(slot, slot - 1)).alias("slot"))
    return simple_edges(a.join(b, ["event_type", "slot"]).where(f"ub > ua and ub <= ua + {width}"))


def customers_and_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bipartite graph of customers and suppliers (shifted by ten million)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return simple_edges(orders.join(lines, "o_orderkey").select(F.col("o_custkey").alias("u"), (F.col("l_suppkey") + 10_000_000).alias("v")))


#: SQL of the same graphs: common table expressions that end in e(u, v), and n(node, k), adj(u, v).
COMMON = """
adj AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
n AS MATERIALIZED (SELECT u AS node, count(*)::BIGINT AS k FROM adj GROUP BY u)"""


def parts_sql(least_quantity: int = 40) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS u, greatest(a.l_partkey, b.l_partkey) AS v
    FROM lineitem a JOIN lineitem b USING (l_orderkey)
    WHERE a.l_partkey < b.l_partkey AND a.l_quantity >= {least_quantity} AND b.l_quantity >= {least_quantity}),{COMMON}"""


def users_sql(seconds: int = 120) -> str:
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT least(a.user_id, b.user_id) AS u, greatest(a.user_id, b.user_id) AS v
    FROM events a JOIN events b ON a.event_type = b.event_type AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL {seconds} SECOND
    WHERE a.user_id <> b.user_id),{COMMON}"""
