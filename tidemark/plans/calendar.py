"""Queries over days and weeks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import activity as A
from tidemark.operators import calendar as C
from tidemark.plans.activity import COALESCED_SQL
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, activities, as_of, table

_DAYS = "days AS (SELECT date, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds FROM activities GROUP BY 1), d AS (SELECT max(date) AS as_of FROM activities)"
_SPINE = "spine AS (SELECT CAST(unnest(generate_series(CAST(date_trunc('week', as_of) AS DATE) - INTERVAL 77 DAY, CAST(date_trunc('week', as_of) AS DATE) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS date, as_of FROM d)"
_MAP = "m AS (SELECT s.date, coalesce(total_seconds, 0) AS total_seconds, s.date > as_of AS future FROM spine s LEFT JOIN days USING (date))"


def _days(spark, sf_dir):
    a = activities(spark, sf_dir)
    return A.totals(a, "date").drop("records"), as_of(a)


def _text(df):
    return df.withColumn("date", F.col("date").cast("string"))


@query(f"WITH {ACTIVITIES_SQL}, {_DAYS}, {_SPINE}, {_MAP} SELECT CAST(date AS VARCHAR) AS date, total_seconds, future FROM m")
def calendar_heatmap(spark, sf_dir):
    return _text(C.heatmap(*_days(spark, sf_dir), 12))


@query(f"""WITH {ACTIVITIES_SQL}, {_DAYS}, {_SPINE}, {_MAP}, t AS (SELECT greatest(3600, max(total_seconds)) AS top FROM m)
SELECT CAST(date AS VARCHAR) AS date, total_seconds, future, CASE WHEN total_seconds <= 0 THEN 0 WHEN total_seconds / top < 0.18 THEN 1 WHEN total_seconds / top < 0.45 THEN 2 WHEN total_seconds / top < 0.75 THEN 3 ELSE 4 END AS level FROM m, t""")
def calendar_heat_levels(spark, sf_dir):
    return _text(C.heat_levels(C.heatmap(*_days(spark, sf_dir), 12)))


@query(f"""WITH {COALESCED_SQL}, d AS (SELECT max(date) AS as_of FROM activities), a AS (SELECT DISTINCT date FROM effective WHERE activity_type <> 'review'),
i AS (SELECT date, date - CAST(row_number() OVER (ORDER BY date) AS INT) AS island FROM a), r AS (SELECT count(*) AS n, max(date) AS last FROM i GROUP BY island)
SELECT coalesce(max(n), 0) AS streak FROM r, d WHERE as_of - last <= 1""")
def activity_streak(spark, sf_dir):
    a = activities(spark, sf_dir)
    return C.streak(A.meaningful_days(a), as_of(a))


@query(f"""WITH {ACTIVITIES_SQL}, {_DAYS}, s AS (SELECT CAST(unnest(generate_series(as_of - INTERVAL 44 DAY, CAST(as_of AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM d)
SELECT CAST(date AS VARCHAR) AS date, coalesce(total_seconds, 0) AS total_seconds, round(coalesce(total_seconds, 0) / 60, 1) AS minutes FROM s LEFT JOIN days USING (date)""")
def reading_history_ndays(spark, sf_dir):
    return _text(C.history(*_days(spark, sf_dir), 45))


@query(f"""WITH {ACTIVITIES_SQL}, d AS (SELECT max(date) AS as_of FROM activities), s AS (SELECT CAST(unnest(generate_series(as_of - INTERVAL 6 DAY, CAST(as_of AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM d),
f AS (SELECT date, {", ".join(f"CAST(sum(duration_seconds) FILTER (domain = '{x}') AS BIGINT) AS {x}" for x in A.DOMAINS)}, count(output_ref) AS outputs FROM activities GROUP BY 1)
SELECT CAST(date AS VARCHAR) AS date, CAST(isodow(date) - 1 AS INT) AS weekday, {", ".join(f"coalesce({x}, 0) AS {x}" for x in (*A.DOMAINS, "outputs"))} FROM s LEFT JOIN f USING (date)""")
def last7_trend(spark, sf_dir):
    a = activities(spark, sf_dir)
    return _text(C.trend(a, as_of(a)))


_WEEK = "strftime({d}, '%G-W%V')"


@query(f"""WITH {ACTIVITIES_SQL}, w AS (SELECT {_WEEK.format(d='date')} AS week, CAST(date AS VARCHAR) AS date, duration_seconds AS s FROM activities)
SELECT coalesce(week, 'all') AS week, coalesce(date, 'all') AS date, count(*) AS records, CAST(sum(s) AS BIGINT) AS total_seconds FROM w GROUP BY ROLLUP (week, date)""")
def week_rollup(spark, sf_dir):
    w = C.week_rollup(activities(spark, sf_dir))
    return w.select(F.coalesce("week", F.lit("all")).alias("week"), F.coalesce(F.col("date").cast("string"), F.lit("all")).alias("date"), "records", "total_seconds")


@query(f"""WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT DISTINCT {_WEEK.format(d='d')} AS week, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS monday, CAST(CAST(date_trunc('week', d) AS DATE) + 6 AS VARCHAR) AS sunday FROM o""")
def iso_week_bounds(spark, sf_dir):
    weeks = table(spark, sf_dir, "orders").select(C.iso_week(F.to_date("o_orderdate")).alias("week")).distinct()
    monday, sunday = C.week_bounds(F.col("week"))
    return weeks.select("week", monday.cast("string").alias("monday"), sunday.cast("string").alias("sunday"))


@query(f"""WITH {ACTIVITIES_SQL} SELECT CAST(date AS VARCHAR) AS date, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds,
  {", ".join(f"CAST(coalesce(sum(duration_seconds) FILTER ((CASE WHEN domain IN ('medicine', 'politics', 'english') THEN domain ELSE 'other' END) = '{x}'), 0) AS BIGINT) AS {x}" for x in (*A.DOMAINS, "other"))},
  count(DISTINCT domain) AS subjects, count(DISTINCT resource_id) AS resources FROM activities GROUP BY 1""")
def log_entries(spark, sf_dir):
    return _text(C.log_entries(activities(spark, sf_dir)))


@query(f"""WITH {ACTIVITIES_SQL} SELECT CAST(date AS VARCHAR) AS date, CAST(sum(duration_seconds) AS BIGINT) AS total_seconds,
  {", ".join(f"CAST(coalesce(sum(duration_seconds) FILTER (domain = '{x}' AND activity_type = 'read'), 0) AS BIGINT) AS {x}_reading" for x in A.DOMAINS)},
  {", ".join(f"count(DISTINCT resource_id || '/' || item_id) FILTER (activity_type = '{t}') AS {t}_items" for t in ("objective_practice", "subjective_practice"))},
  CAST(least(100, greatest(0, round(sum(duration_seconds) * 100 / 28800))) AS BIGINT) AS percent FROM activities GROUP BY 1""")
def daily_goal_progress(spark, sf_dir):
    return _text(C.goal_progress(activities(spark, sf_dir), 28800))


@query(f"""WITH {ACTIVITIES_SQL}, w AS (SELECT date, count(DISTINCT item_id) AS n FROM activities WHERE domain = 'english' GROUP BY 1), d AS (SELECT max(date) AS as_of FROM activities)
SELECT CAST(sum(n) AS BIGINT) AS words, CAST(coalesce(sum(n) FILTER (date = as_of), 0) AS BIGINT) AS today, count(*) FILTER (n > 0) AS active_days FROM w, d""")
def vocab_totals(spark, sf_dir):
    a = activities(spark, sf_dir)
    words = a.where("domain = 'english'").groupBy("date").agg(F.count_distinct("item_id").alias("words_count"))
    return C.vocab_totals(words, as_of(a))
