"""Event-window queries (an extension beyond the text and evaluation operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import table
from sparkloom.streaming import events as E
from sparkloom.streaming.state import stateful_sessions


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return E.tumbling(table(spark, d, "events"), "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))


def event_sliding(spark: SparkSession, d: str) -> DataFrame:
    return E.sliding(table(spark, d, "events"), "1 day", "12 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = E.sessions(table(spark, d, "events"), "6 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("finish").cast("timestamp_ntz").alias("finish"), "n")


def click_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each client's clicks, at most 30 minutes apart; clicks without a time are left out."""
    out = stateful_sessions(table(spark, d, "clicks").select("client_id", "ts", "value"), "client_id", "ts", "value", 1800)
    return out.select("key", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n", F.round("total", 4).alias("total"))


QUERIES = {f.__name__: f for f in (event_windows, event_sliding, event_sessions, click_sessions)}
# RANGE: events of one instant belong to one session, however a window orders them
ORACLE_SQL = {
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "event_sliding": "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL '12 hours', ts), time_bucket(INTERVAL '12 hours', ts) - INTERVAL '12 hours']) AS s FROM events) GROUP BY 1",
    "click_sessions": "WITH m AS (SELECT client_id AS key, ts, coalesce(value, 0) AS value, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM clicks WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM m) SELECT key, min(ts) AS first, max(ts) AS last, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY key, k",
    "event_sessions": "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS finish, count(*) AS n FROM s GROUP BY user_id, k",
}
