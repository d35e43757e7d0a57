"""Test tables and the two versions of ``orders`` that the join and reconcile queries compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the price in cents, so that sums and texts are exact."""
    return load(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


ORDERS = """
orders_c AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents
  FROM orders)"""


def old_orders(spark: SparkSession, folder: str) -> DataFrame:
    """First version: orders, some of them entered twice."""
    base = orders(spark, folder)
    twice = base.where(
        "o_orderpriority = '3-MEDIUM' OR (o_orderpriority = '1-URGENT' AND cents > 25000000)"
    )
    return base.unionByName(twice)


def new_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Second version: pending orders withdrawn or re-entered under another key, prices and texts changed."""
    base = orders(spark, folder)
    kept = base.where("o_orderstatus <> 'P'")
    again = kept.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'")
    pending = base.where("o_orderstatus = 'P'").withColumn("o_orderkey", -F.col("o_orderkey") - 1)
    moved = pending.where("o_orderpriority = '2-HIGH'")
    moved_twice = pending.where("o_orderpriority = '1-URGENT'")
    together = kept.unionByName(again).unionByName(moved).unionByName(moved_twice).unionByName(moved_twice)
    return together.withColumns({
        "cents": F.when(F.col("o_orderpriority") == "5-LOW", F.floor(F.col("cents") * 104 / 100)).otherwise(F.col("cents")),
        "o_orderpriority": F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "").otherwise(F.col("o_orderpriority")),
        "o_orderdate": F.when(
            (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "2-HIGH"),
            F.expr("o_orderdate + INTERVAL 1 DAY"),
        ).otherwise(F.col("o_orderdate")),
    })


VERSIONS = ORDERS + """,
old_orders AS (
  SELECT * FROM orders_c
  UNION ALL
  SELECT * FROM orders_c WHERE o_orderpriority = '3-MEDIUM' OR (o_orderpriority = '1-URGENT' AND cents > 25000000)),
pending AS (
  SELECT -o_orderkey - 1 AS o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate, cents
  FROM orders_c WHERE o_orderstatus = 'P'),
rows_of_new AS (
  SELECT * FROM orders_c WHERE o_orderstatus <> 'P'
  UNION ALL SELECT * FROM orders_c WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'
  UNION ALL SELECT * FROM pending WHERE o_orderpriority = '2-HIGH'
  UNION ALL SELECT * FROM pending WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT * FROM pending WHERE o_orderpriority = '1-URGENT'),
new_orders AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS o_orderpriority,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN o_orderdate + INTERVAL 1 DAY
              ELSE o_orderdate END AS o_orderdate,
         CASE WHEN o_orderpriority = '5-LOW' THEN (cents * 104) // 100 ELSE cents END AS cents
  FROM rows_of_new)"""

CATEGORY = """CASE WHEN l = 1 AND r = 1 THEN 'A' WHEN l = 1 AND r = 0 THEN 'B' WHEN l = 0 AND r = 1 THEN 'C'
  WHEN l > 1 AND r = 1 THEN 'D' WHEN l = 1 AND r > 1 THEN 'E' WHEN l > 1 AND r > 1 THEN 'F'
  WHEN l > 1 AND r = 0 THEN 'G' ELSE 'H' END"""


def counted(left: str, right: str, left_key: str, right_key: str) -> str:
    """CTE ``counted(k, l, r, cat)`` of the keys of two tables."""
    return f"""
counted AS (
  SELECT k, l, r, {CATEGORY} AS cat FROM (
    SELECT k, CAST(sum(l) AS BIGINT) AS l, CAST(sum(r) AS BIGINT) AS r FROM (
      SELECT {left_key} AS k, 1 AS l, 0 AS r FROM {left} UNION ALL SELECT {right_key}, 0, 1 FROM {right})
    GROUP BY k))"""


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
