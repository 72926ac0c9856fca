"""Panels cut from the driver's tables, as DataFrames and as SQL, for plans that need a market to run on.

Money is summed as decimals, so both engines agree to the last digit whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def week_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, id, price, volume, mcap``: brands by week; price per unit, sales, and sales to date."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    weeks = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), F.col("p_brand").alias("id")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).cast("double").alias("volume"), F.sum("l_quantity").alias("quantity")
    )
    running = F.sum(F.col("volume").cast(MONEY)).over(Window.partitionBy("id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return weeks.select("date", "id", (F.col("volume") / F.col("quantity")).alias("price"), "volume", running.cast("double").alias("mcap"))


WEEK = """
week0 AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS volume, sum(l_quantity) AS quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
week AS (SELECT date, id, volume / quantity AS price, volume, CAST(sum(CAST(volume AS DECIMAL(18,2))) OVER (PARTITION BY id ORDER BY date ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS mcap FROM week0)
"""


def dense_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly panel on all weeks, with ``date_idx``, ``r`` (log return) and ``m`` (mean ``r`` of the week)."""
    from quantloom.operators import panel

    weeks = week_panel(spark, sf_dir)
    dense = panel.densify(weeks, panel.calendar(weeks))
    dense = dense.withColumn("r", F.round(F.ln(F.col("price") / panel.lag("price")), 9))
    return dense.withColumn("m", F.round(F.avg("r").over(Window.partitionBy("date")), 9))


DENSE = WEEK + """,
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS date_idx FROM (SELECT DISTINCT date FROM week)),
spine AS (SELECT id, date, date_idx FROM (SELECT DISTINCT id FROM week), cal),
dense0 AS (SELECT s.id, s.date, s.date_idx, price, volume, mcap FROM spine s LEFT JOIN week w ON s.id = w.id AND s.date = w.date),
dense1 AS (SELECT *, round(ln(price / lag(price) OVER (PARTITION BY id ORDER BY date)), 9) AS r FROM dense0),
dense AS (SELECT *, round(avg(r) OVER (PARTITION BY date), 9) AS m FROM dense1)
"""


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``snapshot_date, id, mcap``: customers by order month, the month's orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.last_day(F.to_date("o_orderdate")).alias("snapshot_date"), F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("mcap"))


SNAP = """
snap AS (SELECT CAST(last_day(o_orderdate) AS DATE) AS snapshot_date, o_custkey AS id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS mcap FROM orders GROUP BY 1, 2)
"""


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()


DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)"


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``date, id, n, value``: users by day; events and the sum of their values, rounded to cents."""
    events = table(spark, sf_dir, "events").select("ts", "user_id", "value")
    return events.groupBy(F.to_date("ts").alias("date"), F.col("user_id").alias("id")).agg(
        F.count("*").alias("n"), F.sum(F.round("value", 2).cast(MONEY)).cast("double").alias("value")
    )


USER = """
usr AS (SELECT CAST(ts AS DATE) AS date, user_id AS id, count(*) AS n, CAST(sum(CAST(round(value, 2) AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2)
"""


def clusters(ids: DataFrame) -> DataFrame:
    """A given clustering of brands: the number in the name modulo 3."""
    return ids.withColumn("cluster", F.regexp_extract("id", r"(\d+)$", 1).cast("int") % 3)


CLUSTER = "CAST(regexp_extract(id, '([0-9]+)$', 1) AS INTEGER) % 3"
