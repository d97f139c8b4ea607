"""Queries of the statistics page. Notes are documents, written on a day that their id gives; legacy days hold a third of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import statistics as S
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, ATTEMPTS_SQL, SECTIONS_SQL, activities, as_of, attempts, sections, table

_NOTES_SQL = """notes AS (SELECT doc_id AS section_id, text AS markdown, CAST((SELECT min(CAST(ts AS DATE)) FROM events) + CAST(doc_id % 45 AS INT) AS DATE) AS date FROM documents WHERE doc_id % 5 = 0 AND trim(text, ' ') <> '')"""
_PERCENT = "CAST(CASE WHEN {1} > 0 THEN floor({0} * 100.0 / {1} + 0.5) ELSE 0 END AS BIGINT)"


def notes(spark, sf_dir):
    first = activities(spark, sf_dir).agg(F.min("date").alias("first"))
    rows = table(spark, sf_dir, "documents").where("doc_id % 5 = 0").crossJoin(F.broadcast(first))
    return rows.select(F.col("doc_id").alias("section_id"), F.col("text").alias("markdown"), F.date_add("first", (F.col("doc_id") % 45).cast("int")).alias("date"))


def _facts(spark, sf_dir):
    a = activities(spark, sf_dir)
    legacy = a.where("ord % 3 = 0").groupBy("date").agg((F.sum("duration_seconds") * 4).alias("reading_seconds"))
    return S.day_facts(legacy, a, notes(spark, sf_dir), a.where("activity_type = 'review' AND ord % 2 = 0"))


_FACTS_SQL = f"""{ACTIVITIES_SQL}, {_NOTES_SQL}, u AS (
  SELECT date, sum(duration_seconds) * 4 AS l, 0 AS s, 0 AS a, 0 AS n, 0 AS c, 0 AS r FROM activities WHERE ord % 3 = 0 GROUP BY 1 UNION ALL SELECT date, 0, duration_seconds, 1, 0, 0, 0 FROM activities
  UNION ALL SELECT date, 0, 0, 0, 1, length(markdown), 0 FROM notes UNION ALL SELECT date, 0, 0, 0, 0, 0, 1 FROM activities WHERE activity_type = 'review' AND ord % 2 = 0),
facts AS (SELECT date, CAST(sum(l) AS BIGINT) AS legacy_seconds, CAST(sum(s) AS BIGINT) AS unified_seconds, CAST(sum(a) AS BIGINT) AS activities, CAST(sum(n) AS BIGINT) AS notes, CAST(sum(c) AS BIGINT) AS note_chars, CAST(sum(r) AS BIGINT) AS reviews,
  CAST(greatest(sum(l), sum(s)) AS BIGINT) AS effective_seconds, CAST(greatest(0, sum(l) - sum(s)) AS BIGINT) AS residual_seconds, sum(a) + sum(l) + sum(n) + sum(r) > 0 AS active FROM u GROUP BY 1)"""


@query(f"WITH {_FACTS_SQL} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM facts")
def statistics_by_day(spark, sf_dir):
    return _facts(spark, sf_dir).withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {_FACTS_SQL} SELECT count(*) FILTER (active) AS active_days, CAST(sum(legacy_seconds) AS BIGINT) AS legacy_seconds, CAST(sum(unified_seconds) AS BIGINT) AS unified_seconds,
  CAST(sum(residual_seconds) AS BIGINT) AS residual_seconds, CAST(sum(notes) AS BIGINT) AS notes, CAST(sum(note_chars) AS BIGINT) AS note_chars FROM facts""")
def statistics_totals(spark, sf_dir):
    return S.totals(_facts(spark, sf_dir))


@query(f"WITH {SECTIONS_SQL}, {_NOTES_SQL} SELECT book_id, count(n.section_id) AS notes, count(*) AS sections FROM sections s LEFT JOIN notes n USING (section_id) GROUP BY 1")
def note_coverage(spark, sf_dir):
    return S.notes_per_book(sections(spark, sf_dir), notes(spark, sf_dir))


@query(f"""WITH {ACTIVITIES_SQL}, {SECTIONS_SQL}, {_NOTES_SQL}, a AS (SELECT CAST(substring(resource_id, 5) AS BIGINT) AS section_id, date, ord, duration_seconds FROM activities),
o AS (SELECT section_id, sum(duration_seconds) AS seconds, max(ord) AS ord, arg_max(date, (date, ord)) AS date, max((date, ord)) AS last FROM a GROUP BY 1),
k AS (SELECT s.section_id, book_id, seconds, o.date, o.last, o.section_id IS NOT NULL OR n.section_id IS NOT NULL AS learned FROM sections s LEFT JOIN o USING (section_id) LEFT JOIN notes n ON n.section_id = s.section_id)
SELECT book_id, CAST(coalesce(sum(seconds), 0) AS BIGINT) AS seconds, count(*) FILTER (learned) AS learned, count(*) AS sections, {_PERCENT.format("count(*) FILTER (learned)", "count(*)")} AS coverage,
  CAST(max(date) AS VARCHAR) AS last_day, arg_max(section_id, last) FILTER (last IS NOT NULL) AS last_section FROM k GROUP BY 1""")
def book_summary(spark, sf_dir):
    a = activities(spark, sf_dir).withColumn("section_id", F.substring("resource_id", 5, 20).cast("long"))
    return S.book_summary(sections(spark, sf_dir), a, notes(spark, sf_dir).where(F.trim("markdown") != "")).withColumn("last_day", F.col("last_day").cast("string"))


@query(f"""WITH {ATTEMPTS_SQL}, c AS (SELECT trim(text, ' ') AS t FROM conversations WHERE role = 'assistant' AND trim(text, ' ') <> ''), r AS (SELECT count(correct) AS answered, count(*) FILTER (correct) AS "right" FROM attempts)
SELECT answered, "right", (SELECT count(*) FROM c) AS analyses, CAST((SELECT coalesce(sum(length(t)), 0) FROM c) AS BIGINT) AS analysis_chars, {_PERCENT.format('"right"', "answered")} AS accuracy FROM r""")
def practice_summary(spark, sf_dir):
    return S.practice_summary(attempts(spark, sf_dir), table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("text").alias("content")))


@query(f"""WITH {SECTIONS_SQL}, {ATTEMPTS_SQL}, {_NOTES_SQL}, r AS (SELECT question_id, count(correct) AS a, count(*) FILTER (correct) AS c FROM attempts GROUP BY 1)
SELECT domain, count(DISTINCT book_id) AS books, count(*) AS sections, count(n.section_id) AS notes, CAST(coalesce(sum(a), 0) AS BIGINT) AS answers, CAST(coalesce(sum(c), 0) AS BIGINT) AS "right",
  {_PERCENT.format("count(n.section_id)", "count(*)")} AS coverage, {_PERCENT.format("coalesce(sum(c), 0)", "coalesce(sum(a), 0)")} AS accuracy FROM sections s LEFT JOIN notes n USING (section_id) LEFT JOIN r ON question_id = s.section_id GROUP BY 1""")
def subject_tiles(spark, sf_dir):
    a = attempts(spark, sf_dir).withColumnRenamed("question_id", "section_id")
    return S.subject_tiles(sections(spark, sf_dir), notes(spark, sf_dir).where(F.trim("markdown") != ""), a)


@query(f"""WITH {ACTIVITIES_SQL}, d AS (SELECT * FROM activities WHERE date = (SELECT max(date) FROM activities)), t AS (SELECT * FROM d ORDER BY ord DESC LIMIT 8)
SELECT CAST(floor(sum(duration_seconds) / 60.0) AS BIGINT) AS minutes, count(*) AS activities, (SELECT string_agg(activity_id, ',' ORDER BY ord) FROM t) AS last FROM d""")
def today_facts(spark, sf_dir):
    a = activities(spark, sf_dir)
    return S.today(a, as_of(a)).withColumn("last", F.array_join("last", ","))


@query(f"""WITH {ACTIVITIES_SQL}, {_NOTES_SQL}, l AS (SELECT date, 0 AS rank, min(markdown) AS content FROM notes GROUP BY 1 UNION ALL SELECT date, 1, count(*) || ' activities' FROM activities GROUP BY 1),
b AS (SELECT date, min(rank) AS rank, arg_min(content, rank) FILTER (trim(content, ' ') <> '') AS content FROM l GROUP BY 1)
SELECT CAST(date AS VARCHAR) AS date, rank = 1 AS only_activity, CASE WHEN length(content) > 100 THEN substring(content, 1, 100) || '…' ELSE coalesce(content, '') END AS preview FROM b""")
def reading_log(spark, sf_dir):
    learned = activities(spark, sf_dir).groupBy("date").agg(F.concat(F.count(F.lit(1)), F.lit(" activities")).alias("content"))
    archived = notes(spark, sf_dir).where(F.trim("markdown") != "").groupBy("date").agg(F.min("markdown").alias("content"))
    return S.log_days(archived, learned).withColumn("date", F.col("date").cast("string"))


@query(f"""WITH {ACTIVITIES_SQL}, {ATTEMPTS_SQL} SELECT DISTINCT activity_type AS kind, item_id AS item FROM activities WHERE item_id IS NOT NULL UNION SELECT 'objective_practice', CAST(question_id AS VARCHAR) FROM attempts""")
def seen_items(spark, sf_dir):
    a = attempts(spark, sf_dir).select(F.lit("objective_practice").alias("kind"), F.col("question_id").cast("string").alias("item"))
    return S.seen_items(activities(spark, sf_dir).select(F.col("activity_type").alias("kind"), F.col("item_id").alias("item")), a)
