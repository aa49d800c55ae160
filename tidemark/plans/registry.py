"""Registry of the toolkit's queries, keyed by inventory id and a slug, and the panels they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import days, hours, resample_mean
from ..operators.qc import plausible, qc_gate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame with its DuckDB text."""
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(c: Column | str, n: int = 4) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """(series, t, v, user_id, value): events as sub-hourly readings, gated by flag and plausibility."""
    e = table(spark, sf, "events")
    v = plausible(qc_gate(F.col("value"), F.pmod("user_id", F.lit(3)), (0, 1)), 0, 300)
    return e.select(F.col("event_type").alias("series"), hours("ts").alias("t"), v.alias("v"), "user_id", "value")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """(series, t, y, ta, sw): the hourly panel, scaled by a number that leaves no rounding ties; y and ta null in empty hours, sw from the clock."""
    h = resample_mean(readings(spark, sf).withColumn("ta", F.col("user_id") * 0.2), ["series"], ["v", "ta"])
    return h.select("series", "t", (F.col("v") / 0.997).alias("y"), (F.col("ta") / 0.997).alias("ta"), (F.pmod("t", F.lit(24)) * 20.0).alias("sw"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(series, d, y, n): orders by priority and day."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), days(F.col("o_orderdate")).alias("d")).agg((F.avg("o_totalprice") / 997).alias("y"), F.count(F.lit(1)).alias("n"))


PANEL = """ev AS (SELECT event_type AS series, date_diff('hour', TIMESTAMP '1970-01-01', date_trunc('hour', ts)) AS t,
  CASE WHEN user_id % 3 IN (0, 1) AND value BETWEEN 0 AND 300 THEN value END AS v, user_id, value FROM events),
sp AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
gr AS (SELECT series, unnest(generate_series(lo, hi)) AS t FROM (SELECT DISTINCT series FROM ev), sp),
h AS (SELECT gr.series, gr.t, avg(v) / 0.997::DOUBLE AS y, avg(user_id * 0.2::DOUBLE) / 0.997::DOUBLE AS ta, (gr.t % 24) * 20.0::DOUBLE AS sw FROM gr LEFT JOIN ev ON ev.series = gr.series AND ev.t = gr.t GROUP BY gr.series, gr.t)"""
DAILY = """o AS (SELECT o_orderpriority AS series, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, avg(o_totalprice) / 997 AS y, count(*) AS n FROM orders GROUP BY ALL)"""
