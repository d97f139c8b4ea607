"""Queries over question banks: a bank for each brand, a question for each part, with faults by its key."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import banks as B
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_SHA = "a" * 64
_SOURCES = 8
_BANKS_SQL = f"""q AS (SELECT p_brand AS bank, p_partkey AS k, p_size AS size, p_size % 2 = 1 AS many, p_partkey % 61 = 0 AS broken FROM part),
good AS (SELECT *, k % 13 <> 0 AS linked FROM q WHERE NOT broken),
each AS (SELECT bank, unnest(list_filter([
  CASE WHEN k % 97 = 0 THEN ('E013', 1) END, CASE WHEN k % 41 = 0 THEN ('E042', 1) END, CASE WHEN k % 11 = 0 THEN ('W010', 1) END, CASE WHEN k % 31 = 0 THEN ('E016', 1) END, CASE WHEN k % 31 <> 0 AND k % 43 = 0 THEN ('E057', 1) END,
  CASE WHEN k % 37 = 0 THEN ('E017', 1) END, CASE WHEN k % 7 = 0 THEN ('E019', 1) END, CASE WHEN k % 7 = 0 AND many THEN ('W003', 1) END, CASE WHEN NOT linked THEN ('W002', 1) END, CASE WHEN linked AND k % 60 >= 25 THEN ('E022', 1) END,
  CASE WHEN k % 17 = 0 THEN ('E023', 1) END, CASE WHEN k % 17 <> 0 AND (size % 10 >= {_SOURCES} OR k % 6 = 5) THEN ('E024', 1) END, CASE WHEN k % 19 = 0 THEN ('E025', 1) END, CASE WHEN k % 23 = 0 THEN ('E026', 1) END,
  CASE WHEN k % 29 = 0 THEN ('E027', 1) END, CASE WHEN k % 29 <> 0 AND k % 5 = 0 THEN ('W016', 1) END, CASE WHEN k % 53 = 0 THEN ('W013', 1) END, CASE WHEN k % 53 <> 0 AND k % 59 = 0 THEN ('E055', 1) END], lambda x: x IS NOT NULL)) AS f FROM good),
named AS (SELECT DISTINCT bank, k % 60 AS id FROM good WHERE linked),
others AS (SELECT bank, 'E006' AS code, count(*) AS n FROM q WHERE broken GROUP BY 1 UNION ALL SELECT DISTINCT bank, unnest(['E007', 'E008']), 1 FROM q WHERE broken
  UNION ALL SELECT bank, 'E014', count(*) - 1 FROM good WHERE k % 97 = 0 GROUP BY 1 HAVING count(*) > 1
  UNION ALL SELECT bank, 'W001', count(*) FROM (SELECT DISTINCT bank FROM q) b, nation WHERE NOT EXISTS (SELECT 1 FROM named WHERE named.bank = b.bank AND id = n_nationkey) GROUP BY 1
  UNION ALL SELECT DISTINCT bank, 'E012', 1 FROM q UNION ALL SELECT DISTINCT bank, 'E033', 1 FROM q),
found AS (SELECT bank, code, CASE WHEN code[1] = 'E' THEN 'blocker' ELSE 'warning' END AS severity, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT bank, f[1] AS code, f[2] AS n FROM each UNION ALL FROM others) GROUP BY 1, 2)"""


def _lines(spark, sf_dir):
    k = F.col("p_partkey")
    option = lambda label, text: F.struct(F.lit(label).alias("label"), text.alias("text_md"))
    answers = F.when(k % 7 == 0, F.array(F.lit("D"))).when(F.col("p_size") % 2 == 1, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    ref = F.struct(F.concat(F.lit("s"), F.col("p_size") % 10).alias("source_id"), F.concat(F.lit("b"), k % 6).alias("block_id"))
    none = F.array().cast("array<string>")
    record = F.struct(
        F.when(k % 97 == 0, "Q?").otherwise(F.concat(F.lit("part-"), k)).alias("question_id"), F.when(k % 41 == 0, "other").otherwise(F.col("p_brand")).alias("bank_id"),
        F.when(F.col("p_size") % 2 == 1, "multiple_choice").otherwise("single_choice").alias("question_type"), F.when(k % 11 == 0, "hard").otherwise("basic").alias("difficulty"),
        F.when(k % 31 == 0, "  ").when(k % 43 == 0, "![a](b)").otherwise(F.col("p_name")).alias("stem_md"),
        F.array(option("A", F.lit("one")), option("B", F.lit("two")), option("C", F.when(k % 37 == 0, "").otherwise("three"))).alias("options"), answers.alias("correct_answers"),
        F.when(k % 13 == 0, none).otherwise(F.array(F.concat(F.lit("x.k"), k % 60))).alias("knowledge_ids"), F.filter(F.array(ref), lambda _: k % 17 != 0).alias("source_refs"),
        F.when(k % 19 != 0, F.concat(F.lit("because "), k)).alias("source_analysis_md"), F.when(k % 23 == 0, "draft").otherwise("ready").alias("status"),
        F.when(k % 29 != 0, F.array(F.struct(F.when(k % 5 == 0, "odd").otherwise("ocr_fix").alias("type"), F.lit("scan").alias("reason")))).alias("transformations"),
        F.when(k % 53 != 0, F.when(k % 59 == 0, F.lit(0)).otherwise(k)).alias("local_number"),
    )
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("bank"), F.lit(B.FORMAL).alias("path"), k.alias("line"), F.when(k % 61 == 0, "{broken").otherwise(F.to_json(record)).alias("text"))


def _files(spark, sf_dir):
    """Four files a brand; the entries of the map are the nations."""
    many = F.count_if(F.col("p_size") % 2 == 1)
    brands = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("bank")).agg(F.count(F.lit(1)).alias("n"), many.alias("many"))
    entries = table(spark, sf_dir, "nation").agg(F.collect_list(F.struct(F.concat(F.lit("x.k"), "n_nationkey").alias("knowledge_id"), F.lit("topic").alias("kind"), F.col("n_name").alias("label"), F.array("n_name").alias("path"))).alias("entries"))
    t, of = F.lit("t"), lambda i: F.concat(F.lit("s"), i).alias("source_id")
    common = [F.lit("f").alias("filename"), F.lit(_SHA).alias("sha256"), F.lit("primary").alias("role")]
    block = lambda j: F.struct(F.concat(F.lit("b"), j).alias("block_id"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    source = lambda i: F.struct(of(i), F.lit("F").alias("display_name"), *common, F.transform(F.sequence(F.lit(0), F.lit(4)), block).alias("blocks"))
    node = lambda path: F.struct(F.lit(path).alias("path"), F.lit(_SHA).alias("sha256"))
    texts = {
        B.MANIFEST: F.struct(
            F.lit(1).alias("schema_version"), F.struct(F.col("bank").alias("id"), t.alias("title"), t.alias("domain"), t.alias("subject"), t.alias("resource_type"), F.lit("ready").alias("status")).alias("bank"),
            F.col("n").alias("question_count"), F.map_filter(F.create_map(F.lit("single_choice"), F.col("n") - F.col("many"), F.lit("multiple_choice"), F.col("many")), lambda _, n: n > 0).alias("question_type_counts"),
            F.transform(F.sequence(F.lit(0), F.lit(_SOURCES)), lambda i: F.struct(of(i), *common)).alias("sources"), node(B.FORMAL).alias("questions"), node(B.MAP).alias("knowledge_map"), node(B.INDEX).alias("source_index"),
            F.struct(F.lit("pass").alias("status"), F.lit(0).alias("blocker_count"), F.lit(0).alias("warning_count")).alias("quality")),
        B.INDEX: F.struct(F.lit(1).alias("index_version"), F.col("bank").alias("bank_id"), F.transform(F.sequence(F.lit(0), F.lit(_SOURCES - 1)), source).alias("sources")),
        B.MAP: F.struct(F.lit(1).alias("map_version"), F.col("bank").alias("bank_id"), "entries"),
    }
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.to_json(x).alias("text")) for p, x in texts.items()], F.struct(F.lit(B.FORMAL).alias("path"), F.lit(None).cast("string").alias("text")))
    return brands.crossJoin(F.broadcast(entries)).select("bank", F.explode(each).alias("f")).select("bank", "f.path", F.lit(_SHA).alias("sha256"), "f.text")


@query(f"WITH {_BANKS_SQL} FROM found")
def bank_findings(spark, sf_dir):
    found = B.validate(_files(spark, sf_dir), _lines(spark, sf_dir))
    return found.groupBy("bank", "code", "severity").agg(F.sum("n").alias("n"))


@query(f"""WITH {_BANKS_SQL} SELECT bank, CAST(coalesce(sum(n) FILTER (severity = 'blocker'), 0) AS BIGINT) AS blockers, CAST(coalesce(sum(n) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings,
CASE WHEN count(*) FILTER (severity = 'blocker') > 0 THEN 'blocked' ELSE 'warning' END AS status FROM found GROUP BY 1""")
def bank_verdicts(spark, sf_dir):
    files = _files(spark, sf_dir)
    return B.verdicts(files, B.validate(files, _lines(spark, sf_dir)))


@query("""SELECT p_brand AS bank, count(*) FILTER (p_partkey % 61 <> 0) AS question_count, 0::BIGINT AS quarantined_count, count(DISTINCT CASE WHEN p_partkey % 61 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN -1 ELSE p_partkey END) AS known_question_ids,
count(*) FILTER (p_partkey % 61 <> 0 AND p_partkey % 29 <> 0) AS transformations_total FROM part GROUP BY 1 HAVING count(*) FILTER (p_partkey % 61 <> 0) > 0""")
def bank_totals(spark, sf_dir):
    return B.totals(B.questions(_lines(spark, sf_dir)))
