"""Records as state of a stream against the batch, and the batch against a plain fold."""

import datetime as dt
import random
import time

import pytest

from tidemark.streaming import records as R

BEATS = "day date, activity_id string, ord long, ts timestamp, seconds long, state string, refs array<string>, key string"
DAY = dt.date(2024, 3, 1)


def beat(ord, activity, seconds, state="in_progress", refs=(), key=None, day=DAY):
    return (day, activity, ord, dt.datetime(2024, 3, 1) + dt.timedelta(seconds=ord), seconds, state, list(refs) if refs is not None else None, key)


def fold(beats):
    out, seen = {}, {}
    for day, activity, ord, ts, seconds, state, refs, key in sorted(beats, key=lambda b: b[2]):
        r = out.get((day, activity))
        if key and key in seen.setdefault((day, activity), set()):
            continue
        seen.setdefault((day, activity), set()).add(key)
        if r is None:
            r = out[day, activity] = [ts, ts, 0, state, [], 0]
        r[1], r[2], r[5] = ts, r[2] + max(0, seconds or 0), r[5] + 1
        if state == "has_output" or r[3] in ("started", "in_progress"):
            r[3] = state
        r[4] += [x for x in dict.fromkeys(refs or []) if x not in r[4]]
    return {k: tuple(v[:4]) + (tuple(v[4]), v[5]) for k, v in out.items()}


def plain(rows):
    return {(r["day"], r["activity_id"]): (r["started_at"], r["last_active_at"], r["duration_seconds"], r["result_state"], tuple(r["output_refs"]), r["beats"]) for r in rows}


def many(n=400, seed=9):
    rng = random.Random(seed)
    return [beat(i, f"a{rng.randint(0, 12)}", rng.choice([20, 7, 0, -3, None]), rng.choice(["started", "in_progress", "in_progress", "completed", "has_output"] if i % 5 == 0 else ["started", "in_progress"]), rng.choice([[], ["x"], ["y", "x", "y"], None]), rng.choice([None, "", f"k{rng.randint(0, 60)}"]), DAY + dt.timedelta(days=i // 250)) for i in range(n)]


def test_records_fold(spark):
    beats = many()
    assert plain(R.records(spark.createDataFrame(beats, BEATS).repartition(5)).collect()) == fold(beats)
    assert R.records(spark.createDataFrame([], BEATS)).count() == 0


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run(spark, tmp_path, batches, done=lambda got: True, **kw):
    """What each micro-batch gives; each list of heartbeats is one. A stream with timers does not end of its own."""
    source, got = tmp_path / "in", []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, BEATS).coalesce(1).write.mode("append").parquet(str(source / f"part={i}"))
    whole = spark.readStream.schema(BEATS).option("maxFilesPerTrigger", 1).parquet(str(source / "*"))
    out = R.record_stream(whole, **kw).writeStream.outputMode("update").foreachBatch(lambda df, _: got.append(df.collect()))
    query = out.option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="100 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until and not (len([g for g in got if g]) >= len(batches) and sum(p["numInputRows"] for p in query.recentProgress) >= sum(map(len, batches)) and done(got)):
            assert query.exception() is None, query.exception()
            time.sleep(0.2)
    finally:
        query.stop()
    return got


def test_stream_is_the_batch(spark, tmp_path, rocksdb):
    beats = many(240, 4) + [beat(900, "twice", 20, key="flush-1"), beat(901, "twice", 7, key="flush-2"), beat(902, "twice", 20, key="flush-1")]
    batches = [beats[:100], beats[100:200] + [beats[240], beat(903, "twice", 50, key="flush-1")], beats[200:240] + beats[241:]]
    got = run(spark, tmp_path, batches)
    last = {}
    for rows in got:
        last |= {(r["day"], r["activity_id"]): r for r in rows}
    assert len([r for r in got if r]) >= 3
    kept = [b for b in beats if b[2] < 900] + [beat(900, "twice", 20, key="flush-1"), beat(901, "twice", 7, key="flush-2")]
    assert plain(last.values()) == plain(R.records(spark.createDataFrame(kept, BEATS)).collect()) == fold(kept)


def test_records_close(spark, tmp_path, rocksdb):
    got = run(spark, tmp_path, [[beat(1, "short", 20, key="k")], [beat(2, "other", 5, key="k")], [beat(3, "third", 5, key="k")]], lambda got: sum(r["closed"] for rows in got for r in rows) >= 3, close_after_ms=1)
    closed = [r for rows in got for r in rows if r["closed"]]
    assert {r["activity_id"] for r in closed} == {"short", "other", "third"} and all(r["duration_seconds"] in (20, 5) for r in closed)


def test_flushes(spark):
    ticks = [("a", 1, dt.datetime(2024, 3, 1, 0, 0, 1), 400), ("a", 2, dt.datetime(2024, 3, 1, 0, 0, 14), 900), ("a", 3, dt.datetime(2024, 3, 1, 0, 0, 15), 1), ("b", 4, dt.datetime(2024, 3, 1, 0, 0, 3), -4)]
    got = sorted(tuple(r)[:2] + (r["seconds"], r["key"]) for r in R.flushes(spark.createDataFrame(ticks, "activity_id string, ord long, ts timestamp, seconds long")).collect())
    assert [(a, n, s) for a, n, s, _ in got] == [("a", 0, 1), ("a", 0, 600), ("a", 1, 600), ("a", 2, 100)] and len({k for *_, k in got}) == 4
