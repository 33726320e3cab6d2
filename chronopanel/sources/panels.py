"""Canonical panels on the driver's tables: long, one row a date and ticker, missing values as NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, close, volume): orders by market segment and Monday of the week."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("ticker"))
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy("date", "ticker").agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).alias("volume"))


WEEKLY = """SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, c_mktsegment AS ticker, avg(o_totalprice) AS close, count(*) AS volume
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ticker, close, volume): line items by return flag and shipping day; has gaps in small tables."""
    items = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.col("l_returnflag").alias("ticker"), "l_extendedprice", "l_quantity")
    return items.groupBy("date", "ticker").agg(F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"))


DAILY = """SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS ticker, avg(l_extendedprice) AS close, sum(l_quantity) AS volume
FROM lineitem GROUP BY ALL"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hour, ticker, n, value): events by type and hour."""
    events = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("hour"), F.col("event_type").alias("ticker"), "value")
    return events.groupBy("hour", "ticker").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


HOURLY = "SELECT date_trunc('hour', ts) AS hour, event_type AS ticker, count(*) AS n, sum(value) AS value FROM events GROUP BY ALL"


def market(panel: DataFrame) -> DataFrame:
    """(date, m_close): the benchmark, the average close of all tickers."""
    return panel.groupBy("date").agg(F.avg("close").alias("m_close"))
