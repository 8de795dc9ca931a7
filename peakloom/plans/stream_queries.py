"""Registered queries of the stream operators, run over the tables as batches; tests run the operators as streams, too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.streaming import streams as T

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.operations(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query(
    "t6_operation_monitor",
    """SELECT epoch_ms(CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600000) AS window_start, event_type AS operation, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_failed,
 round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS failure_rate, quantile_disc(value * 10, 0.95) AS p95_ms FROM events GROUP BY 1, 2""",
)
def operation_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.monitor(_ops(spark, sf_dir), "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "operation", "n", "n_failed", "failure_rate", "p95_ms")


@query(
    "t7_operation_sessions",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS correlation, ts, value * 10 AS ms, CASE WHEN ts < lag(ts) OVER p + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS nw FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY correlation ORDER BY ts) AS k FROM e) SELECT correlation, min(ts) AS session_start, count(*) AS n, round(sum(ms), 4) AS total_ms FROM s GROUP BY correlation, k""",
)
def operation_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.sessions(_ops(spark, sf_dir)).select("correlation", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", "total_ms")


@query("t5_staged_results", "SELECT o_custkey, min(tier) AS tier, arg_min(o_orderkey, tier * 100000000 + o_orderkey) AS payload FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS tier FROM orders) GROUP BY o_custkey")
def staged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local results (finished orders) and later ones: a later row counts only where no local one came."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = o.select("o_custkey", F.when(F.col("o_orderstatus") == "F", 0).otherwise(1).alias("tier"), F.col("o_orderkey").alias("payload"))
    return T.best_rows(rows, ["o_custkey"]).select("o_custkey", "tier", "payload")


@query("p10_t4_freshness", "SELECT event_id, user_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("updated_at", F.col("ts").cast("timestamp"))
    last = marks.agg(F.max("updated_at").alias("as_of"))  # one row
    return T.fresh(marks.crossJoin(F.broadcast(last)), F.col("as_of")).select("event_id", "user_id")
