"""Queries for a start page."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import practice as P
from tidemark.operators import summary as S
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, ATTEMPTS_SQL, activities, attempts, table


@query(f"""WITH {ACTIVITIES_SQL}, {ATTEMPTS_SQL}, f AS (SELECT (SELECT round(sum(duration_seconds) FILTER (domain = 'medicine') * 100 / sum(duration_seconds)) FROM activities) AS p,
  (SELECT count(*) FROM attempts WHERE NOT correct) AS due, (SELECT count(*) FROM attempts WHERE correct) AS mastered, (SELECT count(*) FROM attempts WHERE (NOT correct OR previously_wrong) AND NOT (correct AND previously_wrong)) AS unresolved)
SELECT 'balance' AS kind, CASE WHEN p < 45 THEN 'warning' ELSE 'positive' END AS level, CAST(p AS BIGINT) AS value FROM f UNION ALL SELECT 'recall', 'urgent', due FROM f WHERE due > 0
UNION ALL SELECT 'recall', 'positive', mastered FROM f WHERE due <= 0 AND mastered > 0 UNION ALL SELECT 'mistakes', 'action', unresolved FROM f WHERE unresolved > 0""")
def rule_based_insights(spark, sf_dir):
    a = attempts(spark, sf_dir)
    counts = a.agg(F.count_if(~F.col("correct")).alias("due"), F.count_if("correct").alias("mastered"), F.count_if(P.is_mistake() & ~P.is_resolved()).alias("unresolved"))
    return S.insights(S.medicine_percent(activities(spark, sf_dir)).crossJoin(F.broadcast(counts)))


@query(f"""WITH {ACTIVITIES_SQL}, d AS (SELECT date, count(*) AS n, CAST(sum(duration_seconds) AS BIGINT) AS s FROM activities GROUP BY 1), m AS (SELECT max(n) AS m, max(s) AS t FROM d)
SELECT CAST(date AS VARCHAR) AS date, CAST(CASE WHEN n <= 0 THEN 0 ELSE least(4, greatest(1, ceil(ln(n + 1) / ln(m + 1) * 4))) END AS INT) AS level, CAST(greatest(7200, ceil(t * 1.25 / 1800) * 1800) AS BIGINT) AS top FROM d, m""")
def activity_levels(spark, sf_dir):
    days = activities(spark, sf_dir).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_seconds").alias("s"))
    rows = days.crossJoin(F.broadcast(days.agg(F.max("n").alias("m"), F.max("s").alias("t"))))
    return rows.select(F.col("date").cast("string").alias("date"), S.log_level(F.col("n"), F.col("m")).alias("level"), S.chart_top(F.col("t")).alias("top"))


@query(f"""WITH {ACTIVITIES_SQL}, p AS (SELECT date, resource_id, count(*) AS n, sum(duration_seconds) AS s, max(duration_seconds) AS m, bool_or(activity_type = 'review') AS r FROM activities GROUP BY 1, 2)
SELECT CAST(date AS VARCHAR) AS date, CAST(sum(n) AS BIGINT) AS opens, count(*) AS resources, max(m) AS longest, bool_or(r) AS review_saved, CAST(max(s) AS BIGINT) AS most_seconds FROM p GROUP BY 1""")
def daily_counters(spark, sf_dir):
    return S.daily_counters(activities(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


@query("""WITH s AS (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS start FROM conversations GROUP BY 1), k AS (SELECT c.conv_id, turn FROM conversations c JOIN s USING (conv_id) WHERE turn >= coalesce(start, turn))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INT) AS number FROM k""")
def prefix_trim(spark, sf_dir):
    return S.trimmed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "assistant").drop("role")


@query("SELECT s_suppkey, CAST(place AS INT) AS place FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier) WHERE place BETWEEN 3 AND 4")
def page_slice(spark, sf_dir):
    return S.page(table(spark, sf_dir, "supplier"), 2, 2, F.desc("s_acctbal"), F.col("s_suppkey")).select("s_suppkey", "place")


@query(f"""WITH {ACTIVITIES_SQL}, u AS (SELECT resource_id, max(ord) AS used FROM activities WHERE activity_type = 'read' GROUP BY 1), i AS (SELECT 'res-' || c_custkey AS resource_id, c_name FROM customer)
SELECT resource_id, c_name, CAST(row_number() OVER (ORDER BY used DESC NULLS LAST, c_name, resource_id) AS INT) AS place FROM i LEFT JOIN u USING (resource_id)""")
def recent_shelf(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.concat(F.lit("res-"), "c_custkey").alias("resource_id"), "c_name")
    return S.shelf(items, activities(spark, sf_dir).where("activity_type = 'read'").select("resource_id", "ord"), "resource_id", "c_name").withColumn("place", F.col("place").cast("int"))


@query("""WITH w AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS w FROM orders), l AS (SELECT w, lag(month(w)) OVER (ORDER BY w) AS before FROM w)
SELECT CAST(w AS VARCHAR) AS week_start, CASE WHEN before IS NULL OR before <> month(w) THEN month(w) || '月' ELSE '' END AS label FROM l""")
def month_labels(spark, sf_dir):
    weeks = table(spark, sf_dir, "orders").select(F.date_trunc("week", "o_orderdate").cast("date").alias("week_start")).distinct()
    return S.month_labels(weeks).withColumn("week_start", F.col("week_start").cast("string"))
