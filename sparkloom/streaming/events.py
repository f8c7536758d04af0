"""Event-time windows, sessions and stream dedup over event tables; batch and streaming frames alike. An extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) per window; on a stream, rows later than `late` are left out."""
    e = _timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    out = e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = "10 minutes") -> DataFrame:
    e = _timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy(F.window("ts", size, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(user_id, start, finish, n): events of a user with less than `gap` between neighbours."""
    e = _timed(events)
    e = e.withWatermark("ts", late) if e.isStreaming else e
    out = e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("finish"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First arrivals: within the watermark on a stream, over all rows in a batch."""
    e = _timed(events)
    return e.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if e.isStreaming else e.dropDuplicates(keys)


def tail_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only folder of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def upsert_sink(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Micro-batches to an idempotent merge(rows, epoch), restartable from `checkpoint`."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
