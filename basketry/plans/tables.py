
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def basket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, item, node, pos): an order is a basket, a part an item, a supplier a node."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("item"), F.col("l_suppkey").alias("node"), F.col("l_linenumber").alias("pos")
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, title, owner): a part's brand owns it."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_brand").alias("owner")
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, pid, node, pos, title, owner)."""
    return basket_items(spark, sf_dir).join(items(spark, sf_dir), "item")


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, name): market segment and order priority make a basket's title."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("pid"),
        F.lower(F.concat_ws(" ", "c_mktsegment", "o_orderpriority")).alias("name"),
    )


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name): a part's name as a short title."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def supplier_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(owner, basket_count) with suppliers as owners."""
    from ..operators import stats

    return stats.reach(basket_items(spark, sf_dir), "node", "pid")


def listens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, ts, track, artist, ms, type): events as plays; k is the track, k modulo 10 its artist, value in ms."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", k.alias("track"), (k % 10).alias("artist"), F.round(F.col("value") * 1000).cast("bigint").alias("ms"), F.col("event_type").alias("type")
    )


# SQL of the views above, to be put after WITH.
ROWS = "rows AS (SELECT l_partkey AS item, l_orderkey AS pid, l_suppkey AS node, l_linenumber AS pos, p_name AS title, p_brand AS owner FROM lineitem JOIN part ON l_partkey = p_partkey)"
BASKETS = "baskets AS (SELECT o_orderkey AS pid, lower(concat_ws(' ', c_mktsegment, o_orderpriority)) AS name FROM orders JOIN customer ON o_custkey = c_custkey)"
REACH = "reach AS (SELECT l_suppkey AS owner, count(DISTINCT l_orderkey) AS basket_count FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1)"
PLAYS = """plays AS (SELECT event_id, user_id, ts, CAST(json_extract_string(props, '$.k') AS INT) AS track,
    CAST(json_extract_string(props, '$.k') AS INT) % 10 AS artist, CAST(round(value * 1000) AS BIGINT) AS ms, event_type AS type FROM events)"""


def edges_sql(least: int = 1, top: int | None = None) -> str:
    """edges (a, b, weight) and both (src, dst, weight) of the supplier graph."""
    kept = "" if top is None else f"WHERE l_suppkey IN (SELECT l_suppkey FROM (SELECT l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT {top}))"
    return f"""pairs AS (SELECT DISTINCT l_orderkey AS pid, l_suppkey AS node FROM lineitem {kept}),
    edges AS (SELECT x.node AS a, y.node AS b, count(*) AS weight FROM pairs x JOIN pairs y ON x.pid = y.pid AND x.node < y.node
              GROUP BY 1, 2 HAVING count(*) >= {least}),
    both_ways AS (SELECT a AS src, b AS dst, weight FROM edges UNION ALL SELECT b, a, weight FROM edges)"""
