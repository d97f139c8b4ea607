"""Queries over data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import findings as Q
from tidemark.plans.registry import query
from tidemark.sources.tables import table

# a question for each part, with faults by its key
_QUESTIONS_SQL = """q AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 = 0 THEN '?' ELSE 'part-' || p_partkey END AS question_id,
  CASE p_size % 3 WHEN 0 THEN 'single_choice' WHEN 1 THEN 'multiple_choice' ELSE 'essay' END AS question_type, CASE WHEN p_partkey % 31 = 0 THEN '  ' ELSE p_name END AS stem_md,
  p_size % 5 AS n_options, CASE WHEN p_partkey % 7 = 0 THEN 'B' WHEN p_partkey % 7 = 1 THEN 'F' ELSE 'A' END AS a1, p_partkey % 4 = 0 AS two, CASE WHEN p_partkey % 5 = 0 THEN 'A' ELSE 'B' END AS a2,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'x.k' || (p_partkey % 60) END AS kid, p_partkey % 17 = 0 AS no_ref, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE p_brand END AS analysis,
  CASE WHEN p_partkey % 23 = 0 THEN 'draft' ELSE 'ready' END AS status, CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) - 1 END AS local_number, p_brand AS unit FROM part),
f AS (SELECT question_id AS id, unnest(list_filter([
  CASE WHEN NOT regexp_matches(question_id, '^[A-Za-z0-9][A-Za-z0-9._-]{3,}$') THEN 'E013' END, CASE WHEN question_type NOT IN ('single_choice', 'multiple_choice') THEN 'E015' END, CASE WHEN trim(stem_md) = '' THEN 'E016' END,
  CASE WHEN n_options < 2 THEN 'E017' END, CASE WHEN (a1 <> 'A' AND ascii(a1) - 65 >= n_options) OR (a1 = 'A' AND n_options = 0) OR (two AND (ascii(a2) - 65 >= n_options)) THEN 'E019' END,
  CASE WHEN question_type = 'single_choice' AND two THEN 'E020' END, CASE WHEN no_ref THEN 'E023' END, CASE WHEN analysis IS NULL THEN 'E025' END, CASE WHEN status <> 'ready' THEN 'E026' END, CASE WHEN local_number < 1 THEN 'E055' END,
  CASE WHEN kid IS NULL THEN 'W002' END, CASE WHEN question_type = 'multiple_choice' AND NOT two THEN 'W003' END, CASE WHEN two AND a1 = a2 THEN 'W009' END, CASE WHEN local_number IS NULL THEN 'W013' END], lambda x: x IS NOT NULL)) AS code FROM q
  UNION ALL SELECT question_id, 'E028' FROM (SELECT *, row_number() OVER (PARTITION BY unit, question_type, local_number ORDER BY k) AS n FROM q) WHERE n > 1
  UNION ALL SELECT question_id, 'E022' FROM q WHERE kid IS NOT NULL AND kid NOT IN (SELECT 'x.k' || n_nationkey FROM nation)),
findings AS (SELECT id, CASE WHEN code LIKE 'E%' THEN 'blocker' ELSE 'warning' END AS severity, code FROM f)"""


def _questions(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    option = lambda i: F.struct(F.char(i + 65).alias("label"), F.lit("text").alias("text_md"))
    first = F.when(k % 7 == 0, "B").when(k % 7 == 1, "F").otherwise("A")
    second = F.when(k % 5 == 0, "A").otherwise("B")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), F.when(k % 97 == 0, "?").otherwise(F.concat(F.lit("part-"), k)).alias("question_id"),
        F.when(size % 3 == 0, "single_choice").when(size % 3 == 1, "multiple_choice").otherwise("essay").alias("question_type"), F.when(k % 31 == 0, "  ").otherwise(F.col("p_name")).alias("stem_md"),
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < size % 5), option).alias("options"), F.when(k % 4 == 0, F.array(first, second)).otherwise(F.array(first)).alias("correct_answers"),
        F.when(k % 13 != 0, F.array(F.concat(F.lit("x.k"), k % 60))).otherwise(F.array().cast("array<string>")).alias("knowledge_ids"), F.when(k % 17 != 0, F.array("p_type")).alias("source_refs"),
        F.when(k % 19 != 0, F.col("p_brand")).alias("source_analysis_md"), F.when(k % 23 == 0, "draft").otherwise("ready").alias("status"), F.when(k % 29 != 0, size.cast("long") - 1).alias("local_number"), F.col("p_brand").alias("unit"),
    )


def _findings(spark, sf_dir):
    q = _questions(spark, sf_dir)
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("x.k"), "n_nationkey").alias("knowledge_id"))
    return (
        Q.row_findings(q, Q.question_rules(), "question_id")
        .unionByName(Q.repeated(q, "question_id", "k", "E028", "unit", "question_type", "local_number"))
        .unionByName(Q.unresolved(q, known, "question_id", "knowledge_ids", "knowledge_id", "E022"))
    )


@query(f"WITH {_QUESTIONS_SQL} SELECT * FROM findings")
def question_rule_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


@query(f"WITH {_QUESTIONS_SQL} SELECT code, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (severity = 'blocker') > 0 THEN 'blocked' ELSE 'warning' END AS status FROM findings GROUP BY 1")
def findings_rollup(spark, sf_dir):
    return Q.rollup(_findings(spark, sf_dir), "code")


@query(f"WITH {_QUESTIONS_SQL}, bad AS (SELECT DISTINCT unit || question_type AS g FROM q JOIN findings ON id = question_id WHERE code IN ('E013', 'E016')) SELECT question_id FROM q WHERE unit || question_type NOT IN (SELECT g FROM bad)")
def package_admission(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("package", F.concat("unit", "question_type"))
    return Q.admitted(q, _findings(spark, sf_dir).where("code IN ('E013', 'E016')"), "package", "question_id").select("question_id")


_REASONS = """concat_ws(',', CASE WHEN trim(line) = '' THEN 'blank' END, CASE WHEN length(trim(line)) > 60 THEN 'long' END, CASE WHEN regexp_matches(trim(line), '[.!?。！？]$') THEN 'sentence' END,
  CASE WHEN regexp_matches(trim(line), '^[0-9 .]+$') THEN 'numeric' END, CASE WHEN len(regexp_extract_all(trim(line), '[(（]')) <> len(regexp_extract_all(trim(line), '[)）]')) THEN 'unbalanced' END)"""


@query(f"WITH l AS (SELECT split_part(text, chr(10), 1) AS line FROM documents) SELECT {_REASONS} AS reasons, count(*) AS n FROM l GROUP BY 1")
def heading_lint(spark, sf_dir):
    line = F.split("text", "\n")[0]
    return table(spark, sf_dir, "documents").groupBy(Q.heading_lint(line).alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT doc_id, round(length(replace(text, 'the', '')) / greatest(length(text), 1), 4) AS ratio FROM documents) SELECT doc_id, ratio, ratio >= 0.9 AS ok FROM r")
def length_ratio_gate(spark, sf_dir):
    ratio, ok = Q.length_gate(F.col("text"), F.replace("text", F.lit("the"), F.lit("")), 0.9)
    return table(spark, sf_dir, "documents").select("doc_id", ratio.alias("ratio"), ok.alias("ok"))
