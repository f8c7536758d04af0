"""Sessions by keyed state: the batch form, a stream with late rows, and a restart from the checkpoint."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming.state import merged, stateful_sessions

SCHEMA = "client_id long, ts timestamp, value double"
ZERO = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
GAP = 600


def events(seed, n, span=40_000):
    """Client 1 has a third of all rows."""
    rng = random.Random(seed)
    out = [(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, None]), ZERO + dt.timedelta(seconds=rng.randrange(span)), rng.choice([None, 1.0, 2.5])) for _ in range(n)]
    return sorted(out, key=lambda r: r[1])


def by_hand(rows):
    spans = {}
    for k, t, v in rows:
        spans.setdefault(k, []).append((int((t - ZERO).total_seconds()) * 10**6, int((t - ZERO).total_seconds()) * 10**6, 1, v or 0.0))
    return sorted((repr(k), *(s[0], s[1], s[2], round(s[3], 6))) for k, own in spans.items() for s in merged(own, GAP * 10**6))


def rows_of(df):
    us = lambda c: F.unix_micros(c) - int(ZERO.timestamp()) * 10**6
    return sorted((repr(r["key"]), r["f"], r["l"], r["n"], r["total"]) for r in df.select("key", us("first").alias("f"), us("last").alias("l"), "n", "total").collect())


def test_batch(spark):
    rows = events(1, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(stateful_sessions(df, "client_id", "ts", "value", GAP)) == by_hand(rows)
    assert stateful_sessions(df.where("false"), "client_id", "ts", "value", GAP).collect() == []


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_stream_restarts_and_drops_late_rows(rocks, tmp_path):
    """Rows in three files, the query stopped after each: the state goes on from the checkpoint, and a row behind the watermark is left out."""
    spark = rocks
    rows = events(2, 240)
    cuts = [rows[:80], rows[80:160], [*rows[160:], (99, ZERO + dt.timedelta(days=3), 0.0)]]
    late = (1, ZERO, 7.0)  # far behind the watermark when the last file comes
    for i, part in enumerate([*cuts, [late, (99, ZERO + dt.timedelta(days=3, seconds=1), 0.0)]]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
        found = stateful_sessions(stream, "client_id", "ts", "value", GAP, "1 minute")
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = rows_of(spark.read.parquet(f"{tmp_path}/out"))
    assert got == by_hand(rows)


def test_session_sql_keeps_events_of_one_instant_together():
    import duckdb

    from sparkloom.plans.events import ORACLE_SQL

    con = duckdb.connect()
    # each key begins two sessions a day apart, both with clicks of one instant
    con.execute("CREATE TABLE clicks AS SELECT (i * 7919) % 20000 AS client_id, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * day AS ts, CAST(twin AS DOUBLE) AS value FROM range(20000) a(i), range(2) b(day), range(3) c(twin) ORDER BY hash(i * 6 + day * 3 + twin)")
    con.execute("CREATE TABLE events AS SELECT client_id AS user_id, ts FROM clicks")
    assert con.execute(f"SELECT count(*), min(n), max(n), min(total), max(total) FROM ({ORACLE_SQL['click_sessions']})").fetchall() == [(40000, 3, 3, 3.0, 3.0)]
    assert con.execute(f"SELECT count(*), min(n), max(n) FROM ({ORACLE_SQL['event_sessions']})").fetchall() == [(40000, 3, 3)]
