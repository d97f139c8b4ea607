"""Queries that add to a record what other tables know of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import enrichment as E
from tidemark.operators import recall as R
from tidemark.plans.recall import _DUE, _LAST_SQL, _now, _progress
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, ATTEMPTS_SQL, SECTIONS_SQL, activities, attempts, sections, table


@query("""WITH qs AS (SELECT doc_id AS question_id, 'b' || (doc_id % 8) AS bank_id, CASE WHEN doc_id % 3 = 0 THEN 'comprehensive' ELSE 'chapter' END AS scope,
  CASE WHEN doc_id % 10 = 0 THEN [] WHEN doc_id % 4 = 0 THEN ['l.' || coalesce(lang, 'und')] ELSE ['l.' || coalesce(lang, 'und'), 'm.' || (doc_id % 7)] END AS ids FROM documents),
e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_id, 'b' || (CASE WHEN user_id % 9 = 0 THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) % 8 END) AS bank_id,
  CASE WHEN user_id % 3 = 0 THEN 'm.' || (user_id % 7) END AS kid, CASE user_id % 4 WHEN 0 THEN 'comprehensive' WHEN 1 THEN 'odd' WHEN 2 THEN 'chapter' END AS level FROM events),
t AS (SELECT event_id, e.question_id, e.bank_id, len(ids) > 0 AS has, ids, CASE WHEN len(ids) > 0 THEN coalesce(kid, ids[-1]) ELSE kid END AS knowledge_id,
  CASE WHEN NOT coalesce(len(ids) > 0, false) THEN level WHEN level IN ('comprehensive', 'chapter') THEN level WHEN len(ids) > 1 THEN 'section' ELSE 'comprehensive' END AS match_level FROM e LEFT JOIN qs USING (question_id, bank_id)),
p AS (SELECT event_id, count(*) FILTER (q.question_id < t.question_id) AS before, count(*) FILTER (q.question_id = t.question_id) AS own FROM t JOIN qs q ON q.bank_id = t.bank_id AND list_contains(q.ids, t.knowledge_id) AND (t.match_level <> 'comprehensive' OR q.scope = 'comprehensive') WHERE has GROUP BY 1)
SELECT event_id, bank_id, knowledge_id, match_level, CASE WHEN has THEN CAST(CASE WHEN own > 0 THEN before ELSE 0 END AS INT) END AS start_index FROM t LEFT JOIN p USING (event_id)""")
def resume_places(spark, sf_dir):
    d, u = F.col("doc_id"), F.col("user_id")
    lang = F.concat(F.lit("l."), F.coalesce("lang", F.lit("und")))
    ids = F.when(d % 10 == 0, F.array().cast("array<string>")).when(d % 4 == 0, F.array(lang)).otherwise(F.array(lang, F.concat(F.lit("m."), d % 7)))
    scope = F.when(d % 3 == 0, "comprehensive").otherwise("chapter")
    questions = table(spark, sf_dir, "documents").select(F.concat(F.lit("b"), d % 8).alias("bank_id"), d.alias("question_id"), d.alias("ord"), d.alias("number"), scope.alias("scope"), ids.alias("knowledge_ids"))
    key = F.get_json_object("props", "$.k").cast("long")
    targets = table(spark, sf_dir, "events").select(
        "event_id", key.alias("question_id"), F.concat(F.lit("b"), F.when(u % 9 == 0, F.lit(0)).otherwise(key % 8)).alias("bank_id"), F.when(u % 3 == 0, F.concat(F.lit("m."), u % 7)).alias("knowledge_id"),
        F.when(u % 4 == 0, "comprehensive").when(u % 4 == 1, "odd").when(u % 4 == 2, "chapter").alias("match_level"),
    )
    return E.resume_places(targets, questions).select("event_id", "bank_id", "knowledge_id", "match_level", "start_index")


@query(f"""WITH {ACTIVITIES_SQL}, {SECTIONS_SQL}, a AS (SELECT *, CASE WHEN ord % 5 = 0 THEN '' ELSE domain END AS given, CASE WHEN ord % 7 = 0 THEN 's' || (ord % 3) END AS subject, CASE WHEN ord % 2 = 0 THEN ord % 40 END AS number FROM activities),
b AS (SELECT DISTINCT book_id, CASE WHEN length(book_id) % 2 = 0 THEN upper(book_id) ELSE '' END AS title, 'd-' || book_id AS domain, 'x-' || book_id AS subject FROM sections),
j AS (SELECT a.*, s.title AS st, b.book_id AS bid, b.title AS bt, b.domain AS bd, b.subject AS bs, coalesce(b.book_id, a.resource_id) AS rid FROM a LEFT JOIN sections s ON CAST(s.section_id AS VARCHAR) = a.item_id LEFT JOIN b USING (book_id))
SELECT activity_id, activity_type, item_id, CASE activity_type WHEN 'read' THEN coalesce(nullif(st, ''), item_id) WHEN 'subjective_practice' THEN coalesce(nullif(st, ''), item_id) WHEN 'notebook' THEN item_id || ' · 英语周记' WHEN 'review' THEN item_id || ' · 学习回顾'
  ELSE CASE WHEN number IS NULL THEN '题目 ' || item_id ELSE '第 ' || number || ' 题' END END AS title, rid AS resource_id,
CASE activity_type WHEN 'notebook' THEN '英语周记' WHEN 'review' THEN coalesce(subject, nullif(bt, ''), rid) WHEN 'objective_practice' THEN coalesce(CASE WHEN length(bid) % 3 = 0 THEN 'bank ' || bid END, nullif(bt, ''), rid) ELSE coalesce(nullif(bt, ''), rid) END AS resource_title,
coalesce(nullif(given, ''), bd, '') AS domain, coalesce(subject, bs, '') AS subject_id FROM j""")
def home_summary(spark, sf_dir):
    o = F.col("ord")
    a = activities(spark, sf_dir).withColumn("domain", F.when(o % 5 == 0, "").otherwise(F.col("domain"))).withColumn("subject_id", F.when(o % 7 == 0, F.concat(F.lit("s"), o % 3))).withColumn("question_number", F.when(o % 2 == 0, o % 40))
    s = sections(spark, sf_dir).withColumn("section_id", F.col("section_id").cast("string"))
    size = F.length("book_id")
    b = s.select("book_id").distinct().select("book_id", F.when(size % 2 == 0, F.upper("book_id")).otherwise("").alias("title"), F.concat(F.lit("d-"), "book_id").alias("domain"), F.concat(F.lit("x-"), "book_id").alias("subject"))
    banks = b.where(size % 3 == 0).select(F.col("book_id").alias("bank_id"), F.concat(F.lit("bank "), "book_id").alias("title"))
    return E.home_summary(a, s, b, banks)


@query(f"WITH {ATTEMPTS_SQL} SELECT doc_id AS question_id, source AS bank_id, 'note ' || l.quality AS content, a.correct FROM documents JOIN labels l USING (doc_id) LEFT JOIN (SELECT * FROM attempts WHERE question_id % 2 = 0) a ON a.question_id = doc_id WHERE toxic = 0")
def noted_questions(spark, sf_dir):
    questions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.col("source").alias("bank_id"))
    analyses = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("toxic") == 0, F.concat(F.lit("note "), "quality")).otherwise(" \n").alias("content"))
    return E.noted_questions(questions, analyses, attempts(spark, sf_dir).where("question_id % 2 = 0").select("question_id", "correct"))


def _items(spark, sf_dir):
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("item_id"), F.when(c % 3 == 0, "definition").when(c % 3 == 1, "essay").alias("type"), F.when(c % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("subject_id"))


@query(f"""WITH {_LAST_SQL} SELECT CASE WHEN c_custkey % 5 = 0 THEN 'other' ELSE c_mktsegment END AS subject_id, count(*) AS due, count(*) FILTER (c_custkey % 3 = 0) AS definitions, count(*) FILTER (c_custkey % 3 <> 0) AS essays
FROM progress JOIN customer ON c_custkey = item_id, now WHERE mastery <> 'unseen' AND {_DUE} GROUP BY 1""")
def due_by_subject(spark, sf_dir):
    return E.due_by_subject(E.known_due(_progress(spark, sf_dir).where(R.is_due(_now())), _items(spark, sf_dir)))


@query("""SELECT c_custkey AS item_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE coalesce(s_name, '') END AS memory_note, s_suppkey IS NOT NULL AND s_suppkey % 4 <> 0 AS has_note FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def items_with_notes(spark, sf_dir):
    note = F.when(F.col("s_suppkey") % 4 == 0, " \t").otherwise(F.concat(F.lit("  "), "s_name", F.lit("\n")))
    return E.with_notes(_items(spark, sf_dir), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), note.alias("memory_note"))).select("item_id", "memory_note", F.coalesce("has_note", F.lit(False)).alias("has_note"))
