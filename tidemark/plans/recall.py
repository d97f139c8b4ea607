"""Queries over recall items: an item for each user, rated by its events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import recall as R
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_MASTERY = "CASE event_type WHEN 'view' THEN 'learning' WHEN 'click' THEN 'fuzzy' WHEN 'error' THEN 'reviewing' ELSE 'mastered' END"
_LAST_SQL = f"""last AS (SELECT user_id AS item_id, arg_max({_MASTERY}, event_id) AS mastery, arg_max(ts, event_id) + to_hours(CAST(user_id % 300 AS BIGINT)) AS next_review_at FROM events GROUP BY 1),
progress AS (SELECT item_id, mastery, CASE WHEN item_id % 11 = 0 THEN NULL ELSE next_review_at END AS next_review_at FROM last), now AS (SELECT TIMESTAMP '2024-02-03 12:00:00' AS t)"""
_DUE = "(next_review_at IS NULL OR next_review_at <= t OR (mastery IN ('learning', 'fuzzy') AND next_review_at <= t + INTERVAL 2 HOUR))"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-02-03 12:00:00'")


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item_id"), F.col("event_id").alias("ord"), F.col("ts").alias("at"), F.expr(_MASTERY).alias("mastery"))


def _progress(spark, sf_dir):
    last = _ratings(spark, sf_dir).groupBy("item_id").agg(F.max_by(F.struct("mastery", "at"), "ord").alias("s"))
    due = F.col("s.at") + F.expr("make_dt_interval(0, CAST(item_id % 300 AS INT))")
    return last.select("item_id", F.col("s.mastery").alias("mastery"), F.when(F.col("item_id") % 11 != 0, due).alias("next_review_at"))


@query(f"""WITH {_LAST_SQL} SELECT item_id, mastery FROM progress, now WHERE {_DUE}
ORDER BY CASE mastery WHEN 'learning' THEN 0 WHEN 'fuzzy' THEN 1 ELSE 2 END, next_review_at NULLS FIRST, item_id LIMIT 20""")
def due_items_priority(spark, sf_dir):
    return R.due(_progress(spark, sf_dir), _now(), 20).select("item_id", "mastery")


@query(f"WITH {_LAST_SQL} SELECT coalesce(mastery, 'all') AS mastery, count(*) AS due FROM progress, now WHERE {_DUE} GROUP BY GROUPING SETS ((), (mastery))")
def due_counts(spark, sf_dir):
    return R.due_counts(_progress(spark, sf_dir), _now(), "mastery").select(F.coalesce("mastery", F.lit("all")).alias("mastery"), "due")


@query(f"""WITH {_LAST_SQL}, items AS (SELECT c_custkey AS item_id, c_mktsegment AS subject FROM customer)
SELECT subject, count(*) AS total, count(*) FILTER (mastery IS NULL) AS unseen, count(*) FILTER (mastery IN ('learning', 'fuzzy')) AS learning, count(*) FILTER (mastery = 'reviewing') AS reviewing,
  count(*) FILTER (mastery = 'mastered') AS mastered, CAST(round(count(*) FILTER (mastery = 'mastered') * 100 / count(*)) AS BIGINT) AS percent FROM items LEFT JOIN progress USING (item_id) GROUP BY 1""")
def recall_funnel(spark, sf_dir):
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("subject"))
    return R.funnel(items, _progress(spark, sf_dir), "subject")


@query(f"""WITH r AS (SELECT user_id AS item_id, event_id AS ord, ts AS seen_at, {_MASTERY} AS mastery FROM events),
b AS (SELECT item_id, max(ord) FILTER (mastery <> 'mastered') AS broken, max(ord) AS last, count(*) AS ratings, arg_max(mastery, ord) AS mastery, max(seen_at) AS seen FROM r GROUP BY 1)
SELECT item_id, mastery, (SELECT count(*) FROM r WHERE r.item_id = b.item_id AND r.ord > coalesce(b.broken, -1)) AS reps, ratings,
  CASE mastery WHEN 'mastered' THEN 4 WHEN 'fuzzy' THEN 2 ELSE 1 END AS interval_days, CAST(CAST(seen AS DATE) + CASE mastery WHEN 'mastered' THEN 4 WHEN 'fuzzy' THEN 2 ELSE 1 END AS VARCHAR) AS next_review FROM b""")
def spaced_interval_schedule(spark, sf_dir):
    return R.schedule(_ratings(spark, sf_dir)).select("item_id", "mastery", F.col("reps").cast("long").alias("reps"), "ratings", "interval_days", F.col("next_review").cast("string").alias("next_review"))


@query("""WITH a AS (SELECT l_partkey AS question_id, l_orderkey * 10 + l_linenumber AS ord, l_returnflag <> 'R' AS correct FROM lineitem)
SELECT question_id, ord, correct, coalesce(bool_or(NOT correct) OVER w, false) AS previously_wrong, correct AND coalesce(bool_or(NOT correct) OVER w, false) AS resolved
FROM a WINDOW w AS (PARTITION BY question_id ORDER BY ord, correct ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def answer_state_machine(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_returnflag") != "R").alias("correct"))
    return R.answer_states(a)
