"""Streaming queries over the events, run through once and compared with the batch result."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from motionloom.plans.base import Registry
from motionloom.runtime import shared_dir, table
from motionloom.streaming import live

R = Registry()
_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, d):
    table(spark, d, "events")
    return live.file_stream(spark, d, "events.parquet", _EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(df, mode="append"):
    return live.run_to_files(df, f"{shared_dir(df.sparkSession)}/streams/{uuid.uuid4().hex}", mode)


@R.add("r1_buffered_stream", """WITH b AS (SELECT user_id, ts, sum(value) OVER w AS total, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
  SELECT user_id, round(total, 6) AS total FROM b WHERE n = 5""")
def r1_buffered_stream(spark, d):
    return _run(live.buffered_sums(_events(spark, d), "user_id", "ts", "value")).select("user_id", F.round("total", 6).alias("total"))


@R.add("r4_live_gestures", "SELECT event_id, CASE WHEN event_type <> 'NoGesture' AND least(value / 100, 1) < 0.4::DOUBLE THEN 'NoGesture' ELSE event_type END AS gesture, event_id / 20.0::DOUBLE AS timestamp FROM events")
def r4_live_gestures(spark, d):
    rows = live.two_clocks(_events(spark, d).withColumn("c", F.least(F.col("value") / 100, F.lit(1.0))), "event_id", "value")
    return _run(live.live_gestures(rows, "event_type", "c", 0.4).select("event_id", "gesture", "timestamp"))


@R.add("r5_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS end_time, count(*) AS n FROM s GROUP BY user_id, k""")
def r5_sessions(spark, d):
    return _run(live.online_sessions(_events(spark, d), "user_id", "ts"), "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_time"), "n")


@R.add("r_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def r_windowed_counts(spark, d):
    return _run(live.windowed_counts(_events(spark, d), "ts", "1 hour", None, "1 day", "event_type"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
