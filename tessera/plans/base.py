"""Shared views of the driver's tables, in Spark and in SQL.

part = event_type, cell = hour, track = user_id, amplitude = value, all times in
microseconds or seconds since the start of 2024.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import exact

HOUR = 3_600_000_000
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL twin (None: SQL can't express it)."""

    def keep(f):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, part, value, us, t (seconds), hour."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    out = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("part"), "value", us.alias("us"))
    return out.withColumn("t", F.col("us") / 1e6).withColumn("hour", F.expr(f"us div {HOUR}"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour, part, amount: exact sums, combined before the shuffle."""
    return events(spark, sf_dir).groupBy("hour", "part").agg(exact(F.sum(exact(F.col("value")))).alias("amount"))


EV = """ev AS (SELECT event_id, user_id, event_type AS part, value, epoch_us(ts) - 1704067200000000 AS us,
  (epoch_us(ts) - 1704067200000000) / 1e6 AS t, (epoch_us(ts) - 1704067200000000) // 3600000000 AS hour FROM events)"""
HOURLY = EV + """, hp AS (SELECT hour, part, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DECIMAL(18,4)) AS amount FROM ev GROUP BY hour, part)"""


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with price (exact, discounted) and month."""
    price = exact(F.col("l_extendedprice").cast("decimal(14,2)") * (1 - F.col("l_discount").cast("decimal(4,2)")))
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    return table(spark, sf_dir, "lineitem").withColumn("price", price).withColumn("month", month)


REV = """li AS (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS price,
  CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS month FROM lineitem)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, parent, label of the tree root > region > nation > supplier."""
    t = lambda n: table(spark, sf_dir, n)
    root = spark.createDataFrame([("root", None, "all")], "key string, parent string, label string")
    r = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("key"), F.lit("root").alias("parent"), F.col("r_name").alias("label"))
    n = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.col("n_name").alias("label"))
    s = t("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("parent"), F.col("s_name").alias("label"))
    return root.unionByName(r).unionByName(n).unionByName(s)


NODES = """nodes AS (SELECT 'root' AS key, CAST(NULL AS VARCHAR) AS parent, 'all' AS label
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"""


def r6(c):
    return F.round(c, 6)
