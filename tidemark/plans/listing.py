"""Queries of lists: filters, tabs, orders and redacted views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import listing as L
from tidemark.operators import practice as P
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, ATTEMPTS_SQL, SECTIONS_SQL, activities, attempts, sections, table


@query(f"WITH {ACTIVITIES_SQL} SELECT activity_id, resource_id, duration_seconds FROM activities WHERE activity_type = 'notebook'")
def activities_of_type(spark, sf_dir):
    return L.filtered_activities(activities(spark, sf_dir), kind="notebook").select("activity_id", "resource_id", "duration_seconds")


@query("SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 OR role <> 'assistant' THEN text END AS text FROM conversations")
def answer_safe_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return L.redacted(c.select("conv_id", "turn", "role", "text"), ("text",), (F.col("conv_id") % 3 == 0) | (F.col("role") != "assistant"))


@query(f"WITH {SECTIONS_SQL} SELECT book_id, title FROM sections WHERE domain = 'en' AND character_count > 0 AND NOT regexp_matches(title, '[0-9]') AND contains(lower(title || ' ' || book_id), 'a')")
def shelf_filter(spark, sf_dir):
    s = sections(spark, sf_dir).where((F.col("domain") == "en") & (F.col("character_count") > 0) & ~F.col("title").rlike("[0-9]"))
    return s.where(F.lower(F.concat_ws(" ", "title", "book_id")).contains("a")).select("book_id", "title")


@query("SELECT CASE WHEN turn + 1 <= 20 THEN 'cloze' WHEN turn + 1 <= 40 THEN 'reading' ELSE 'writing' END AS band, role, count(*) AS n FROM conversations GROUP BY 1, 2")
def question_bands(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(L.band(F.col("turn") + 1).alias("band"), "role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b') OR regexp_matches(p_name, '(^| )g[a-m]')")
def test_paper_groups(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").startswith("b") | F.col("p_name").rlike("(^| )g[a-m]")).select("p_partkey", "p_name")


_MISTAKES_SQL = f"{ATTEMPTS_SQL}, m AS (SELECT question_id, coalesce(lang, 'unknown') AS domain, correct AND previously_wrong AS resolved FROM attempts JOIN documents ON doc_id = question_id WHERE NOT correct OR previously_wrong)"


def _mistakes(spark, sf_dir):
    a = attempts(spark, sf_dir).where(P.is_mistake()).withColumn("resolved", P.is_resolved())
    return a.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.coalesce("lang", F.lit("unknown")).alias("domain")), "question_id")


@query(f"WITH {_MISTAKES_SQL} SELECT domain, count(*) AS total, count(*) FILTER (NOT resolved) AS pending, count(*) FILTER (resolved) AS resolved FROM m GROUP BY 1")
def mistake_tabs(spark, sf_dir):
    return L.tab_counts(_mistakes(spark, sf_dir), "domain", pending=~F.col("resolved"), resolved=F.col("resolved"))


@query(f"WITH {_MISTAKES_SQL} SELECT question_id, domain, row_number() OVER (PARTITION BY domain ORDER BY resolved DESC, question_id % 97 DESC, question_id) AS place FROM m")
def mistakes_newest_first(spark, sf_dir):
    m = _mistakes(spark, sf_dir).withColumn("answered_at", F.col("question_id") % 97)
    return L.newest_resolved_first(m, "domain", F.col("resolved"), "answered_at", "question_id").select("question_id", "domain", F.col("place").cast("long").alias("place"))


@query(f"""WITH {ATTEMPTS_SQL} SELECT d.source, count(*) AS total, count(correct) AS answered, count(*) FILTER (correct) AS correct, count(*) FILTER (NOT correct) AS wrong, count(*) FILTER (doc_id % 11 = 0) AS flagged,
  count(*) FILTER (correct IS NULL) AS unanswered FROM documents d LEFT JOIN attempts ON question_id = doc_id GROUP BY 1""")
def session_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(attempts(spark, sf_dir).withColumnRenamed("question_id", "doc_id"), "doc_id", "left")
    c = F.col("correct")
    return L.tab_counts(rows, "source", answered=c.isNotNull(), correct=c, wrong=~c, flagged=F.col("doc_id") % 11 == 0, unanswered=c.isNull())


@query("""WITH i AS (SELECT source AS chapter_id, doc_id % 4 AS star, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en')
SELECT chapter_id, count(*) AS items, count(*) FILTER (star > 0) AS starred, count(*) FILTER (quality IS NOT NULL) AS completed, CAST(floor(count(*) FILTER (quality IS NOT NULL) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent FROM i GROUP BY 1""")
def recall_chapters(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit("learning").alias("mastery"))
    items = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("chapter_id"), "lang", (F.col("doc_id") % 4).alias("star_level")).join(known, "doc_id", "left")
    return L.chapters_with_items(items, F.col("lang") == "en", L.has_recall(F.lit(" "), F.lit(None).cast("string"), F.col("mastery")))


@query("""WITH n AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_size || ' ' || p_name END AS name FROM part), k AS (SELECT *, regexp_extract(name, '^\\s*(\\d+)', 1) AS x FROM n)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY x = '', TRY_CAST(x AS BIGINT) NULLS FIRST, name, p_partkey) AS place FROM k""")
def chapter_file_order(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat("p_size", F.lit(" "), "p_name")))
    return p.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(L.file_order(F.col("name")), "p_partkey")).cast("long").alias("place"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS nth FROM l WHERE length(trim(title, ' ')) > 0 AND length(title) <= 60) SELECT doc_id, CAST(line AS INT) AS line, title FROM k WHERE nth <= 20""")
def heading_candidates(spark, sf_dir):
    return L.heading_candidates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH a AS (SELECT doc_id AS question_id, CASE WHEN doc_id % 4 = 0 THEN 'gone' ELSE source END AS bank_id, lang FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT source AS bank_id, doc_id AS question_id FROM documents)
SELECT question_id, coalesce(CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.bank_id = a.bank_id AND b.question_id = a.question_id) THEN a.bank_id END, (SELECT min(bank_id) FROM b WHERE b.question_id = a.question_id)) AS bank_id FROM a""")
def domain_filter_before_fallback(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 4 == 0, "gone").otherwise(F.col("source")).alias("bank_id"), F.col("lang").alias("domain"))
    return L.domain_before_fallback(a, d.select(F.col("source").alias("bank_id"), F.col("doc_id").alias("question_id")), "en")


@query("""WITH s AS (SELECT 'lang' AS field, coalesce(lang, 'unknown') AS value FROM documents UNION ALL SELECT 'source', coalesce(source, 'unknown') FROM documents) SELECT field, value, count(*) AS n FROM s GROUP BY 1, 2""")
def question_histograms(spark, sf_dir):
    return L.histograms(table(spark, sf_dir, "documents"), "lang", "source")


@query("""WITH w AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[a-z]+')) AS id FROM documents), k AS (SELECT source, id FROM w) SELECT source, arg_max(id, (length(id), id)) AS longest, count(DISTINCT id) AS ids FROM k GROUP BY 1""")
def longest_knowledge_id(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("id"))
    return ids.groupBy("source").agg(F.max_by("id", F.struct(F.length("id"), "id")).alias("longest"), F.count_distinct("id").alias("ids"))


@query("""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS answers, arg_min(l_returnflag, (l_linenumber, l_returnflag)) AS first_title FROM lineitem GROUP BY 1""")
def answer_sets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("answers"), F.min(F.struct("l_linenumber", "l_returnflag"))["l_returnflag"].alias("first_title"))
