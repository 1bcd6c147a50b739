"""Structured Streaming forms of the telemetry operators, each with a batch twin that the oracle checks.

The streams are an extension: windows with watermarks, sessions, duplicates within a watermark, and a
tracker with state. A stream of files and its batch twin share one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..catalog import builder

LATE = "1 hour"


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events from files as they arrive in a folder; ts becomes a timestamp, as watermarks ask for."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_latency(events: DataFrame) -> DataFrame:
    """Counts, means and errors by hour and type; as a stream, hours close a watermark after their end."""
    windowed = (events.withWatermark("ts", LATE) if events.isStreaming else events).groupBy(F.window("ts", "1 hour"), "event_type")
    return windowed.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("worst")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("hour_start"), "event_type", "n", "mean", "worst")


def user_sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    grouped = (events.withWatermark("ts", LATE) if events.isStreaming else events).groupBy("user_id", F.session_window("ts", gap))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event id once: its first row by time and then by the other columns; as a stream, what comes first within
    the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])
    rest = [c for c in events.columns if c not in ("event_id", "ts")]
    first = events.groupBy("event_id").agg(F.min(F.struct("ts", *rest)).alias("first"))
    return first.select("event_id", "first.*").select(*events.columns)


def failure_tracker(events: DataFrame, limit: int = 5) -> DataFrame:
    """(user_id, failures, open): a circuit breaker's state by user, which opens at `limit` errors."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures = (state.get[0] if state.exists else 0) + sum(int((b.event_type == "error").sum()) for b in batches)
        state.update((failures,))
        yield pd.DataFrame({"user_id": [key[0]], "failures": [failures], "open": [failures >= limit]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, failures long, open boolean", "failures long", "update", GroupStateTimeout.NoTimeout)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """Append a stream of events to JSON lines, each once; returns the running query."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


builder(
    "STR_hourly_latency",
    "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour_start, event_type, count(*) as n, round(avg(value), 6) as mean, round(max(value), 6) as worst from events group by 1, 2",
)(lambda spark, get: hourly_latency(get("events")))
builder(
    "STR_user_sessions",
    """with e as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 2 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
    s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from e)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as n from s group by user_id, k""",
)(lambda spark, get: user_sessions(get("events")))
builder("SNK05_distinct_events", "select distinct event_id, user_id, event_type from events")(lambda spark, get: distinct_events(get("events")).select("event_id", "user_id", "event_type"))
