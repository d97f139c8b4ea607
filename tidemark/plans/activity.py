"""Queries over activity facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import activity as A
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, activities, as_of

_BUCKET = "CASE WHEN domain IN ('medicine', 'politics', 'english') THEN domain ELSE 'other' END"
_DONE = "(result_state IN ('has_output', 'completed') OR refs > 0)"
COALESCED_SQL = f"""{ACTIVITIES_SQL}, ranked AS (
  SELECT *, greatest(CASE result_state WHEN 'completed' THEN 2 WHEN 'has_output' THEN 1 ELSE 0 END, CASE WHEN output_ref IS NULL THEN 0 ELSE 1 END) * 1000000000000 - ord AS r FROM activities
), coalesced AS (
  SELECT date, activity_type, resource_id, item_id, CAST(sum(duration_seconds) AS BIGINT) AS duration_seconds, min(last_active_at) AS started_at, max(last_active_at) AS last_active_at,
    arg_max(result_state, r) AS result_state, arg_max(domain, r) AS domain, arg_min(activity_id, ord) AS activity_id, count(DISTINCT output_ref) AS refs, count(*) AS merged
  FROM ranked GROUP BY date, activity_type, resource_id, item_id
), effective AS (SELECT * FROM coalesced WHERE duration_seconds >= 60 OR {_DONE})"""


@query(f"WITH {ACTIVITIES_SQL} SELECT activity_type, count(*) AS records, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM activities GROUP BY 1")
def activity_totals_by_type(spark, sf_dir):
    return A.totals(activities(spark, sf_dir), "activity_type")


@query(f"""WITH {ACTIVITIES_SQL}, a AS (SELECT activity_type, {_BUCKET} AS domain, duration_seconds AS s FROM activities)
SELECT CASE WHEN activity_type IS NOT NULL THEN 'type' WHEN domain IS NOT NULL THEN 'domain' ELSE 'all' END AS level, coalesce(activity_type, domain, 'all') AS name,
  count(*) AS records, CAST(sum(s) AS BIGINT) AS total_seconds FROM a GROUP BY GROUPING SETS ((activity_type), (domain), ())""")
def activity_totals_grouping_sets(spark, sf_dir):
    return A.totals_by_sets(activities(spark, sf_dir))


@query(f"""WITH {ACTIVITIES_SQL}, a AS (SELECT *, CASE WHEN output_ref IS NULL THEN 0 ELSE 1 END AS refs FROM activities)
SELECT activity_id, activity_type = 'review' AND {_DONE} AS completed_review FROM a WHERE duration_seconds >= 60 OR {_DONE}""")
def meaningful_activity_filter(spark, sf_dir):
    return activities(spark, sf_dir).where(A.is_meaningful()).select("activity_id", A.is_completed_review().alias("completed_review"))


@query(f"""WITH {COALESCED_SQL} SELECT CAST(date AS VARCHAR) AS date, activity_type, resource_id, item_id, duration_seconds, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
  strftime(last_active_at, '%Y-%m-%d %H:%M:%S') AS last_active_at, result_state, domain, activity_id, refs, merged FROM coalesced""")
def coalesced_activity(spark, sf_dir):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return A.coalesced(activities(spark, sf_dir)).select(
        F.col("date").cast("string").alias("date"), "activity_type", "resource_id", "item_id", "duration_seconds", stamp("started_at"), stamp("last_active_at"), "result_state", "domain", "activity_id",
        F.size("output_refs").cast("long").alias("refs"), "merged",
    )


@query(f"WITH {COALESCED_SQL} SELECT activity_type, {_BUCKET} AS domain, count(*) AS records, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM effective GROUP BY 1, 2")
def effective_activity_aggregate(spark, sf_dir):
    return A.totals(A.effective(activities(spark, sf_dir)).withColumn("domain", A.bucket()), "activity_type", "domain")


@query(f"""WITH {COALESCED_SQL} SELECT t.activity_type, count(e.activity_id) AS records, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS total_seconds
FROM (SELECT unnest(['read', 'objective_practice', 'subjective_practice', 'review', 'notebook']) AS activity_type) t LEFT JOIN effective e ON e.activity_type = t.activity_type GROUP BY 1""")
def zero_filled_type_totals(spark, sf_dir):
    return A.zero_filled(A.totals(A.effective(activities(spark, sf_dir)), "activity_type"), "activity_type", A.TYPES)


@query(f"""WITH {COALESCED_SQL} SELECT d.domain, count(e.activity_id) AS records, CAST(coalesce(sum(duration_seconds), 0) AS BIGINT) AS total_seconds
FROM (SELECT unnest(['medicine', 'politics', 'english', 'other']) AS domain) d LEFT JOIN (SELECT activity_id, duration_seconds, {_BUCKET} AS domain FROM effective) e ON e.domain = d.domain GROUP BY 1""")
def domain_totals_other_bucket(spark, sf_dir):
    return A.zero_filled(A.totals(A.effective(activities(spark, sf_dir)).withColumn("domain", A.bucket()), "domain"), "domain", (*A.DOMAINS, "other"))


@query(f"""WITH {COALESCED_SQL} SELECT CAST(date AS VARCHAR) AS date, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds,
  {", ".join(f"CAST(coalesce(sum(duration_seconds) FILTER (activity_type = '{t}'), 0) AS BIGINT) AS {t}" for t in A.TYPES)} FROM effective GROUP BY 1""")
def daily_type_pivot(spark, sf_dir):
    return A.daily_pivot(A.effective(activities(spark, sf_dir))).withColumn("date", F.col("date").cast("string"))


_SLOT = "CASE WHEN hour(last_active_at) BETWEEN 5 AND 11 THEN 'morning' WHEN hour(last_active_at) BETWEEN 12 AND 17 THEN 'afternoon' ELSE 'evening' END"
_SLOTS = ", ".join(f"CAST(coalesce(sum(duration_seconds) FILTER ({_SLOT} = '{s}'), 0) AS BIGINT) AS {s}" for s in A.SLOTS)


@query(f"WITH {ACTIVITIES_SQL} SELECT CAST(date AS VARCHAR) AS date, {_SLOTS} FROM activities GROUP BY 1")
def time_of_day_buckets(spark, sf_dir):
    return A.slots_by_day(activities(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {ACTIVITIES_SQL}, s AS (SELECT {_SLOTS} FROM activities)
SELECT CASE WHEN morning + afternoon + evening = 0 THEN 'evening' WHEN morning = greatest(morning, afternoon, evening) THEN 'morning' WHEN afternoon = greatest(morning, afternoon, evening) THEN 'afternoon' ELSE 'evening' END AS slot,
  greatest(morning, afternoon, evening) AS slot_seconds, CAST(round(greatest(morning, afternoon, evening) * 100 / greatest(1, morning + afternoon + evening)) AS BIGINT) AS percent FROM s""")
def golden_slot(spark, sf_dir):
    return A.golden_slot(activities(spark, sf_dir))


@query(f"""WITH {ACTIVITIES_SQL}, t AS (SELECT CAST(sum(duration_seconds) FILTER (activity_type = 'read') AS BIGINT) AS i, CAST(sum(duration_seconds) FILTER (activity_type <> 'read') AS BIGINT) AS o FROM activities)
SELECT i AS input_seconds, o AS output_seconds, CAST(round(i * 100 / (i + o)) AS BIGINT) AS input_percent, CAST(round(o * 100 / (i + o)) AS BIGINT) AS output_percent FROM t""")
def input_output_ratio(spark, sf_dir):
    return A.input_output_ratio(activities(spark, sf_dir))


@query(f"""WITH {ACTIVITIES_SQL}, t AS (SELECT sum(duration_seconds) FILTER (domain = 'medicine') AS m, sum(duration_seconds) FILTER (domain = 'politics') AS p, sum(duration_seconds) FILTER (domain = 'english') AS e FROM activities),
u AS (SELECT CAST(round(m * 100 / (m + p + e)) AS BIGINT) AS medicine, CAST(round(p * 100 / (m + p + e)) AS BIGINT) AS politics FROM t)
SELECT medicine, politics, greatest(0, 100 - medicine - politics) AS english, CAST(greatest(40, 100 - round((abs(medicine - 60) + abs(politics - 20) + abs(100 - medicine - politics - 20)) / 2)) AS BIGINT) AS score FROM u""")
def subject_balance(spark, sf_dir):
    return A.subject_balance(activities(spark, sf_dir)).withColumn("english", F.col("english").cast("long"))


@query(f"""WITH {ACTIVITIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain, resource_id ORDER BY last_active_at DESC, ord DESC) AS n FROM activities WHERE activity_type <> 'review')
SELECT domain, resource_id, activity_id FROM r WHERE n = 1 ORDER BY last_active_at DESC, ord DESC LIMIT 5""")
def recent_resources(spark, sf_dir):
    return A.recent_resources(activities(spark, sf_dir)).select("domain", "resource_id", "activity_id")


@query(f"WITH {ACTIVITIES_SQL} SELECT activity_id, activity_type, resource_id, item_id FROM activities WHERE activity_type <> 'review' ORDER BY last_active_at DESC, ord DESC LIMIT 1")
def continue_target(spark, sf_dir):
    return A.continue_target(activities(spark, sf_dir))


@query(f"""WITH {COALESCED_SQL}, reviewed AS (SELECT DISTINCT date FROM activities WHERE activity_type = 'review' AND duration_seconds >= 350)
SELECT CAST(max(date) AS VARCHAR) AS pending_day FROM effective WHERE activity_type <> 'review' AND date < (SELECT max(date) FROM activities) AND date NOT IN (SELECT date FROM reviewed)""")
def pending_review_day(spark, sf_dir):
    a = activities(spark, sf_dir)
    reviewed = a.where(A.is_completed_review() & (F.col("duration_seconds") >= 350)).select("date").distinct()
    return A.pending_review_day(a, reviewed, as_of(a)).select(F.col("pending_day").cast("string").alias("pending_day"))
