"""Idempotent heartbeat ingest and idle cut-off, for batches and streams.

The same functions take a static DataFrame or a stream; a stream with a watermark gives in
the end what the batch gives for heartbeats that are not too late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SECONDS = 600
IDLE = "10 minutes"


def valid(beats: DataFrame) -> DataFrame:
    """Heartbeats of 1 to MOST_SECONDS seconds with a plain key; the rest is for a dead-letter table."""
    return beats.where((F.col("seconds") >= 1) & (F.col("seconds") <= MOST_SECONDS) & F.col("key").rlike("^[A-Za-z0-9._:-]{1,160}$"))


def once(beats: DataFrame, delay: str | None = None) -> DataFrame:
    """Each key of a day once. On a stream, delay bounds how long keys are kept."""
    keyed = beats.withColumn("day", F.to_date("ts"))
    if beats.isStreaming:
        return keyed.withWatermark("ts", delay or "1 day").dropDuplicatesWithinWatermark(["day", "key"])
    return keyed.dropDuplicates(["day", "key"])


def accumulated(beats: DataFrame) -> DataFrame:
    """Seconds and heartbeats of each resource and day."""
    return beats.groupBy("day", "resource").agg(F.sum("seconds").alias("seconds"), F.count(F.lit(1)).alias("beats"))


def active_seconds(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Seconds to the next event of a user, cut at ten minutes of idleness; the last event adds none."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = F.lead(at).over(Window.partitionBy(user).orderBy(ts)) - at
    return events.withColumn("active_micros", F.least(F.coalesce(gap, F.lit(0)), F.lit(600_000_000)))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Runs of a user's events without an idle gap; works on streams with a watermark too."""
    return events.groupBy(F.session_window(ts, IDLE), user).agg(F.count(F.lit(1)).alias("events"))


def upsert(state: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """state with the last change of each key put in; keys without a change stay."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in state.columns if c != key]), order).alias("s")).select(key, "s.*").select(*state.columns)
    return state.join(last.select(key), key, "left_anti").unionByName(last)
