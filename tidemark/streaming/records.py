"""Activity records from heartbeats: created, added to and moved on by each heartbeat that is not a repeat.

A heartbeat has day, activity_id, ord (its arrival), ts, seconds, state, refs and key. Of heartbeats
with one key in a record the first counts; those without a key all do. Seconds below 0 add none. A
record is in the state of its first heartbeat; started and in_progress give way to any later state,
has_output to none and all to it. Refs are kept once each, in order of arrival.

records() folds a batch; record_stream() keeps the same record as state in a stream and gives
it anew after each micro-batch that touched it. A flush that is sent again under its key, in
the same batch or in any later one, changes nothing while its key is remembered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: keys that a record remembers, and how long it does without a heartbeat
MOST_KEYS = 256
KEYS_LIVE_MS = 2 * 24 * 3600 * 1000
OPEN = ("started", "in_progress")
RECORD = "day date, activity_id string, started_at timestamp, last_active_at timestamp, duration_seconds long, result_state string, output_refs array<string>, beats long"
_HELD = "started_at timestamp, last_active_at timestamp, duration_seconds long, result_state string, output_refs array<string>, beats long, closes long"


def records(beats: DataFrame) -> DataFrame:
    """A row for each (day, activity_id): RECORD. Heartbeats with equal ord have no defined order among them."""
    named = F.coalesce(F.col("key"), F.lit("")) != ""
    first = beats.where(named).groupBy("day", "activity_id", "key").agg(F.min_by(F.struct("ord", "ts", "seconds", "state", "refs"), "ord").alias("b")).select("day", "activity_id", "b.*")
    once = first.unionByName(beats.where(~named).select(*first.columns))
    left = ~F.col("state").isin(*OPEN)
    state = F.when(F.max(F.col("state") == "has_output"), "has_output").otherwise(F.coalesce(F.min_by(F.when(left, F.col("state")), F.when(left, F.col("ord"))), F.max_by("state", "ord")))
    facts = once.groupBy("day", "activity_id").agg(
        F.min_by("ts", "ord").alias("started_at"), F.max_by("ts", "ord").alias("last_active_at"), F.sum(F.greatest(F.coalesce("seconds", F.lit(0)), F.lit(0))).cast("long").alias("duration_seconds"),
        state.alias("result_state"), F.count(F.lit(1)).alias("beats"),
    )
    shown = once.select("day", "activity_id", "ord", F.posexplode("refs").alias("i", "ref")).groupBy("day", "activity_id", "ref").agg(F.min(F.struct("ord", "i")).alias("at"))
    refs = shown.groupBy("day", "activity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("output_refs"))
    return facts.join(refs, ["day", "activity_id"], "left").select("day", "activity_id", "started_at", "last_active_at", "duration_seconds", "result_state", F.coalesce("output_refs", F.array().cast("array<string>")).alias("output_refs"), "beats")


class _Records(StatefulProcessor):
    """One record, its keys with a time to live, and a timer that closes it after a while without heartbeats."""

    def __init__(self, close_after_ms: int) -> None:
        self.close_after_ms = close_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", _HELD)
        self.keys = handle.getMapState("keys", "key string", "number long", ttlDurationMs=KEYS_LIVE_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.record.get() if self.record.exists() else None
        started, last, seconds, state, refs, beats, closes = held or (None, None, 0, None, [], 0, 0)
        refs, known = list(refs or []), {k[0]: n[0] for k, n in self.keys.iterator()}
        number = max(known.values(), default=0)
        for beat in pd.concat(list(rows)).sort_values("ord", kind="stable").itertuples():
            if beat.key and beat.key in known:
                continue
            if beat.key:
                number += 1
                known[beat.key] = number
                self.keys.updateValue((beat.key,), (number,))
                if len(known) > MOST_KEYS:
                    oldest = min(known, key=known.get)
                    del known[oldest]
                    self.keys.removeKey((oldest,))
            started, last, seconds, beats = started if beats else beat.ts, beat.ts, seconds + max(0, 0 if pd.isna(beat.seconds) else int(beat.seconds)), beats + 1
            state = beat.state if state is None or beat.state == "has_output" or state in OPEN else state
            refs += dict.fromkeys(r for r in (beat.refs if beat.refs is not None else ()) if r not in refs)
        now = timerValues.getCurrentProcessingTimeInMs()
        if closes:
            self.handle.deleteTimer(closes)
        self.handle.registerTimer(now + self.close_after_ms)
        self.record.update((started, last, seconds, state, refs, beats, now + self.close_after_ms))
        yield self._row(key, started, last, seconds, state, refs, beats, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.record.exists():
            *record, closes = self.record.get()
            if closes <= expiredTimerInfo.getExpiryTimeInMs():
                self.record.clear()
                self.keys.clear()
                yield self._row(key, *record, True)

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key: tuple, started, last, seconds, state, refs, beats, closed) -> pd.DataFrame:
        names = ["day", "activity_id", "started_at", "last_active_at", "duration_seconds", "result_state", "output_refs", "beats", "closed"]
        return pd.DataFrame([[*key, started, last, seconds, state, list(refs or []), beats, closed]], columns=names)


def record_stream(beats: DataFrame, close_after_ms: int = KEYS_LIVE_MS) -> DataFrame:
    """A stream of heartbeats as a stream of RECORD and closed, for output mode update. Needs the RocksDB state store.

    A record without heartbeats for so long is given once more, closed, and forgotten with its keys. Because of its timers the
    stream runs on until it is stopped, whatever its trigger.
    """
    return beats.groupBy("day", "activity_id").transformWithStateInPandas(
        statefulProcessor=_Records(close_after_ms), outputStructType=RECORD + ", closed boolean", outputMode="Update", timeMode="ProcessingTime"
    )


def flushes(ticks: DataFrame, every: str = "15 seconds", most: int = 600) -> DataFrame:
    """Heartbeats from ticks (activity_id, ord, ts, seconds): what is pending goes once an interval, most seconds at a time.

    (activity_id, number, ts, seconds, key): what passes most in an interval goes out with the next numbers of that interval.
    A key is made of activity, interval and number, so that a flush that is sent again has the key that it had.
    """
    own = ticks.groupBy("activity_id", F.window("ts", every).alias("w")).agg(F.sum(F.greatest("seconds", F.lit(0))).cast("long").alias("pending"))
    parts = own.where("pending > 0").withColumn("number", F.explode(F.expr(f"sequence(0, cast((pending - 1) div {most} AS int))")))
    key = F.concat_ws("-", "activity_id", F.unix_timestamp("w.end").cast("string"), F.col("number").cast("string"))
    return parts.select("activity_id", F.col("number").cast("long").alias("number"), F.col("w.end").alias("ts"), F.least(F.lit(most), F.col("pending") - F.col("number") * most).cast("long").alias("seconds"), key.alias("key"))
