"""Keyed state with event-time timers: sessions that a stream closes one by one, restartable from its checkpoint. An extension.

Each task first folds its batch into partial sessions, so a key of a third of all rows sends a few rows per batch instead of each of
its rows; the state of a key holds its open sessions only, and a timer closes each when the watermark has passed its gap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
OPEN = T.StructType([T.StructField(c, T.DoubleType() if c == "total" else T.LongType()) for c in ("first", "last", "n", "total")])


def merged(spans: list[tuple], gap: int) -> list[list]:
    """Spans (first, last, n, total) joined where neighbours are at most `gap` apart, in order."""
    out: list[list] = []
    for first, last, n, total in sorted(spans):
        if out and first - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], last)
            out[-1][2] += n
            out[-1][3] += total
        else:
            out.append([first, last, n, total])
    return out


def _partial(gap: int, kind: pa.DataType):
    schema = pa.schema([("key", kind), ("first", pa.int64()), ("last", pa.int64()), ("n", pa.int64()), ("total", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).to_pandas(integer_object_nulls=True).sort_values(["key", "us"], kind="stable")
            new = (rows["key"] != rows["key"].shift()) | (rows["us"].diff() > gap)
            spans = rows.assign(span=new.cumsum()).groupby("span").agg(key=("key", "first"), first=("us", "min"), last=("us", "max"), n=("us", "size"), total=("value", "sum"))
            yield pa.RecordBatch.from_pandas(spans.reset_index(drop=True), schema=schema, preserve_index=False)

    return run, f"key {({v: k for k, v in _KINDS.items()})[kind]}, first long, last long, n long, total double"


class Sessions(StatefulProcessor):
    """Open sessions of a key as list state; one timer, at the earliest end of them."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", OPEN)

    def _due(self, span) -> int:
        """Milliseconds from which a session can take no more rows."""
        return (span[1] + self.gap) // 1000 + 1

    def _keep(self, spans: list) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.open.put([tuple(s) for s in spans])
            self.handle.registerTimer(min(map(self._due, spans)))
        else:
            self.open.clear()

    def _closed(self, key, spans: list) -> Iterator[pd.DataFrame]:
        if spans:
            yield pd.DataFrame({"key": [key[0]] * len(spans), "first": [s[0] for s in spans], "last": [s[1] for s in spans], "n": [s[2] for s in spans], "total": [s[3] for s in spans]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = list(self.open.get()) if self.open.exists() else []
        for part in rows:
            spans += list(zip(*(part[c].tolist() for c in ("first", "last", "n", "total")), strict=True))
        self._keep(merged([tuple(s) for s in spans], self.gap))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # beyond the timer's own time: other sessions may be due as well
        spans = [tuple(s) for s in self.open.get()] if self.open.exists() else []
        self._keep([s for s in spans if self._due(s) > now])
        yield from self._closed(key, [s for s in spans if self._due(s) <= now])

    def close(self) -> None:
        pass


def stateful_sessions(events: DataFrame, key: str, ts: str, value: str, gap_seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, first, last, n, total): runs of a key's events that are at most `gap_seconds` apart, each once it is closed.

    On a stream a session leaves when the watermark, `late` behind the latest event, has passed its end; rows whose partial session ended before
    the watermark are too late and left out. In a batch every session leaves. Rows without a time are left out; a null key is a key;
    null values count as rows and add 0.
    """
    gap = gap_seconds * 1_000_000
    kind = dict(events.dtypes)[key]
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.select(F.col(key).alias("key"), us.alias("us"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("value")).where("us is not null")
    run, schema = _partial(gap, _KINDS[kind])
    spans = rows.mapInArrow(run, schema)
    if not events.isStreaming:
        return _whole(spans, gap, kind)
    spans = spans.withColumn("at", F.timestamp_micros("last")).withWatermark("at", late)
    found = spans.groupBy("key").transformWithStateInPandas(Sessions(gap), f"key {kind}, first long, last long, n long, total double", "append", "eventTime")
    return _timed(found)


def _whole(spans: DataFrame, gap: int, kind: str) -> DataFrame:
    """The batch form: partial sessions joined by windows, so that a key is no single task's memory."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("first") - before > gap), 1).otherwise(0)
    numbered = spans.withColumn("new", new).withColumn("k", F.sum("new").over(w))
    out = numbered.groupBy("key", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    return _timed(out.drop("k"))


def _timed(found: DataFrame) -> DataFrame:
    return found.select("key", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", F.round("total", 6).alias("total"))
