"""Queries over questions, attempts and books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import practice as P
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, ATTEMPTS_SQL, SECTIONS_SQL, activities, attempts, sections, table

_MISTAKE = "(NOT correct OR previously_wrong)"
_RESOLVED = "(correct AND previously_wrong)"


def _questions(spark, sf_dir):
    return sections(spark, sf_dir).select(F.col("section_id").alias("question_id"), F.col("book_id").alias("bank_id"), "domain")


@query(f"WITH {SECTIONS_SQL}, {ATTEMPTS_SQL} SELECT book_id AS bank_id, count(*) AS total, count(correct) AS answered, count(*) FILTER (correct) AS \"right\" FROM sections LEFT JOIN attempts ON section_id = question_id GROUP BY 1")
def practice_session_progress(spark, sf_dir):
    return P.session_progress(_questions(spark, sf_dir), attempts(spark, sf_dir), "bank_id")


@query("SELECT source AS bank_id, lang AS domain, count(DISTINCT doc_id) AS questions FROM documents GROUP BY 1, 2")
def practice_availability(spark, sf_dir):
    return P.availability(_questions(spark, sf_dir), "bank_id", "domain")


@query("""WITH s AS (SELECT p_partkey AS section_id, ['k.' || (p_partkey % 40), 'k.' || (p_partkey % 40) || '.' || p_size] AS ids, 'c.' || (p_partkey % 7) AS chapter FROM part),
q AS (SELECT s_suppkey AS question_id, CASE s_suppkey % 3 WHEN 0 THEN 'k.' || (s_suppkey % 40) WHEN 1 THEN 'k.' || (s_suppkey % 40) || '.' || (s_suppkey % 50) ELSE 'c.' || (s_suppkey % 5) END AS kid FROM supplier),
h AS (SELECT section_id, kid, 0 AS level, question_id FROM s, unnest(ids) AS u(x) JOIN q ON x = kid UNION ALL SELECT section_id, kid, 1, question_id FROM s JOIN q ON chapter = kid),
b AS (SELECT section_id, first(kid ORDER BY level, length(kid) DESC, kid) AS kid FROM h GROUP BY 1)
SELECT section_id, kid AS knowledge_id, count(DISTINCT question_id) AS questions, min(level) AS level FROM h JOIN b USING (section_id, kid) GROUP BY 1, 2""")
def practice_most_specific(spark, sf_dir):
    key, cat = F.col("p_partkey"), F.concat
    base = cat(F.lit("k."), (key % 40).cast("string"))
    s = table(spark, sf_dir, "part").select(key.alias("section_id"), F.array(base, cat(base, F.lit("."), F.col("p_size").cast("string"))).alias("knowledge_ids"), cat(F.lit("c."), (key % 7).cast("string")).alias("chapter_id"))
    n = F.col("s_suppkey")
    kid = F.when(n % 3 == 0, cat(F.lit("k."), (n % 40).cast("string"))).when(n % 3 == 1, cat(F.lit("k."), (n % 40).cast("string"), F.lit("."), (n % 50).cast("string"))).otherwise(cat(F.lit("c."), (n % 5).cast("string")))
    return P.most_specific(s, table(spark, sf_dir, "supplier").select(n.alias("question_id"), kid.alias("knowledge_id")))


@query("""WITH q AS (SELECT DISTINCT l_partkey AS question_id, l_suppkey AS bank_id FROM lineitem), a AS (SELECT DISTINCT p_partkey AS question_id, CAST(p_size AS BIGINT) AS bank_id FROM part)
SELECT question_id, bank_id, first(found_bank ORDER BY CASE WHEN found_bank = bank_id THEN 0 ELSE 1 END, found_bank) AS found_bank FROM (SELECT a.question_id, a.bank_id, q.bank_id AS found_bank FROM a JOIN q USING (question_id)) GROUP BY 1, 2""")
def attempt_bank_fallback(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("bank_id")).distinct().withColumn("bank_order", F.col("bank_id"))
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_size").cast("long").alias("bank_id"))
    return P.in_any_bank(a, q).select("question_id", "bank_id", "found_bank")


@query("""WITH t AS (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(CASE WHEN n = 1 OR role IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS rows, min(turn) AS first, max(turn) AS last, max(length(text)) AS longest FROM r GROUP BY conv_id, run""")
def run_length_groups(spark, sf_dir):
    return P.runs(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").withColumn("longest", F.col("longest").cast("long"))


@query(f"""WITH {ATTEMPTS_SQL}, m AS (SELECT lang AS domain, {_RESOLVED} AS resolved FROM attempts JOIN documents ON doc_id = question_id WHERE {_MISTAKE})
SELECT domain, count(*) AS mistakes, count(*) FILTER (NOT resolved) AS pending, count(*) FILTER (resolved) AS resolved, CAST(round(count(*) FILTER (resolved) * 100 / count(*)) AS BIGINT) AS resolve_percent FROM m GROUP BY 1""")
def mistakes_overview(spark, sf_dir):
    return P.mistake_totals(attempts(spark, sf_dir).join(_questions(spark, sf_dir), "question_id"), "domain")


@query(f"""WITH {ATTEMPTS_SQL} SELECT source AS bank_id, question_id, {_RESOLVED} AS resolved, CAST(row_number() OVER (PARTITION BY source ORDER BY {_RESOLVED} DESC, question_id DESC) AS INT) AS ordinal
FROM attempts JOIN documents ON doc_id = question_id WHERE {_MISTAKE}""")
def mistake_session_ordinals(spark, sf_dir):
    return P.mistake_ordinals(attempts(spark, sf_dir).join(_questions(spark, sf_dir), "question_id"), "bank_id")


@query(f"""WITH {SECTIONS_SQL}, {ATTEMPTS_SQL}, l AS (SELECT DISTINCT question_id AS section_id FROM attempts)
SELECT book_id, count(DISTINCT s.section_id) AS sections, count(DISTINCT l.section_id) AS learned, round(count(DISTINCT l.section_id) * 100 / count(DISTINCT s.section_id), 1) AS percent FROM sections s LEFT JOIN l USING (section_id) GROUP BY 1""")
def book_progress(spark, sf_dir):
    return P.book_progress(sections(spark, sf_dir), attempts(spark, sf_dir).select(F.col("question_id").alias("section_id")))


@query(f"""WITH {SECTIONS_SQL}, {ACTIVITIES_SQL}, t AS (SELECT CAST(item_id AS BIGINT) AS section_id, sum(duration_seconds) AS seconds FROM activities GROUP BY 1)
SELECT s.domain, CAST(sum(seconds) AS BIGINT) AS seconds, count(DISTINCT section_id) AS sections, CAST(sum(character_count) AS BIGINT) AS characters FROM t JOIN sections s USING (section_id) GROUP BY 1""")
def effort_by_domain(spark, sf_dir):
    timed = activities(spark, sf_dir).select(F.col("item_id").cast("long").alias("section_id"), F.col("duration_seconds").alias("seconds"))
    return P.effort_by_domain(sections(spark, sf_dir), timed)


@query(f"""WITH {SECTIONS_SQL} SELECT book_id, min(character_count) AS least, max(character_count) AS most, CAST(round(sum(character_count) / count(character_count)) AS BIGINT) AS mean, CAST(sum(character_count) AS BIGINT) AS total, count(*) FILTER (character_count > 8000) AS oversized FROM sections GROUP BY 1""")
def page_size_stats(spark, sf_dir):
    return P.page_sizes(sections(spark, sf_dir), 8000)
