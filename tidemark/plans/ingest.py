"""Queries over heartbeats and sessions, as batches; the tests hold streams against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources.tables import table
from tidemark.streaming import heartbeats as H
from tidemark.streaming import records as R


def _beats(spark, sf_dir):
    return table(spark, sf_dir, "events").select("ts", F.concat(F.lit("res-"), "user_id").alias("resource"), F.concat_ws(":", F.lit("k"), F.get_json_object("props", "$.k"), "user_id").alias("key"), (F.col("user_id") + 10).alias("seconds"))


@query("""WITH b AS (SELECT DISTINCT CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS k, user_id FROM events WHERE user_id + 10 BETWEEN 1 AND 600)
SELECT CAST(day AS VARCHAR) AS day, 'res-' || user_id AS resource, CAST(sum(user_id + 10) AS BIGINT) AS seconds, count(*) AS beats FROM b GROUP BY 1, 2""")
def heartbeat_dedup(spark, sf_dir):
    return H.accumulated(H.once(H.valid(_beats(spark, sf_dir)))).withColumn("day", F.col("day").cast("string"))


@query("""WITH g AS (SELECT user_id, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts)) - epoch_us(ts) AS gap FROM events)
SELECT user_id, CAST(sum(least(coalesce(gap, 0), 600000000)) // 1000000 AS BIGINT) AS active_seconds FROM g GROUP BY 1""")
def idle_cut_off(spark, sf_dir):
    rows = H.active_seconds(table(spark, sf_dir, "events"))
    return rows.groupBy("user_id").agg(F.floor(F.sum("active_micros") / 1_000_000).cast("long").alias("active_seconds"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g), c AS (SELECT user_id, n, count(*) AS events FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(events) AS longest FROM c GROUP BY 1""")
def idle_session_windows(spark, sf_dir):
    s = H.sessions(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


@query("""WITH st AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), ch AS (SELECT user_id * 7 AS k, CAST(arg_max(CAST(json_extract_string(props, '$.k') AS INT), event_id) AS INT) AS v FROM events GROUP BY 1)
SELECT coalesce(ch.k, st.k) AS k, coalesce(ch.v, st.v) AS v FROM st FULL JOIN ch ON st.k = ch.k""")
def keyed_upsert(spark, sf_dir):
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    changes = table(spark, sf_dir, "events").select((F.col("user_id") * 7).alias("k"), F.get_json_object("props", "$.k").cast("int").alias("v"), "event_id")
    return H.upsert(state, changes, "k", "event_id")


_RECORD_BEATS_SQL = """b AS (SELECT CAST(ts AS DATE) AS day, event_type || '-' || user_id AS activity_id, event_id AS ord, ts, CAST(floor(value) AS BIGINT) - 5 AS seconds, CASE CAST(json_extract_string(props, '$.k') AS INT) % 7 WHEN 0 THEN 'has_output' WHEN 1 THEN 'completed' WHEN 2 THEN 'started' ELSE 'in_progress' END AS state,
CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 5 = 0 THEN NULL ELSE 'key-' || json_extract_string(props, '$.k') END AS key, [ 'out-' || (user_id % 3), 'out-' || (event_id % 4)] AS refs FROM events)"""


def record_beats(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("int")
    state = F.when(k % 7 == 0, "has_output").when(k % 7 == 1, "completed").when(k % 7 == 2, "started").otherwise("in_progress")
    refs = F.array(F.concat(F.lit("out-"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("out-"), (F.col("event_id") % 4).cast("string")))
    return e.select(
        F.to_date("ts").alias("day"), F.concat_ws("-", "event_type", "user_id").alias("activity_id"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"),
        (F.floor("value") - 5).cast("long").alias("seconds"), state.alias("state"), refs.alias("refs"), F.when(k % 5 != 0, F.concat(F.lit("key-"), k.cast("string"))).alias("key"),
    )


@query(f"""WITH {_RECORD_BEATS_SQL}, o AS (SELECT * FROM b QUALIFY key IS NULL OR row_number() OVER (PARTITION BY day, activity_id, key ORDER BY ord) = 1),
r AS (SELECT day, activity_id, ref, min(ord * 10 + i) AS pos FROM (SELECT day, activity_id, ord, unnest(refs) AS ref, generate_subscripts(refs, 1) AS i FROM o) GROUP BY 1, 2, 3), g AS (SELECT day, activity_id, string_agg(ref, ',' ORDER BY pos) AS output_refs FROM r GROUP BY 1, 2)
SELECT CAST(day AS VARCHAR) AS day, activity_id, epoch_us(arg_min(ts, ord)) AS started_us, epoch_us(arg_max(ts, ord)) AS last_active_us, CAST(sum(greatest(seconds, 0)) AS BIGINT) AS duration_seconds,
  CASE WHEN bool_or(state = 'has_output') THEN 'has_output' ELSE coalesce(arg_min(state, ord) FILTER (state NOT IN ('started', 'in_progress')), arg_max(state, ord)) END AS result_state, any_value(output_refs) AS output_refs, count(*) AS beats
FROM o JOIN g USING (day, activity_id) GROUP BY 1, 2""")
def activity_records(spark, sf_dir):
    r = R.records(record_beats(spark, sf_dir))
    return r.select(F.col("day").cast("string").alias("day"), "activity_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_active_at").alias("last_active_us"), "duration_seconds", "result_state", F.array_join("output_refs", ",").alias("output_refs"), "beats")


@query("""WITH p AS (SELECT event_type || '-' || user_id AS activity_id, (epoch_us(ts) // 3600000000 + 1) * 3600 AS ends, CAST(sum(greatest(value * 20, 0)) AS BIGINT) AS pending FROM (SELECT event_type, user_id, ts, floor(value) AS value FROM events) GROUP BY 1, 2),
n AS (SELECT *, unnest(generate_series(0, (pending - 1) // 600)) AS number FROM p WHERE pending > 0) SELECT activity_id, number, least(600, pending - number * 600) AS seconds, activity_id || '-' || ends || '-' || number AS key FROM n""")
def flush_batches(spark, sf_dir):
    ticks = record_beats(spark, sf_dir).withColumn("seconds", (F.col("seconds") + 5) * 20)
    return R.flushes(ticks, "1 hour").select("activity_id", "number", "seconds", "key")
