"""Queries that search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import search as S
from tidemark.plans.registry import query
from tidemark.sources.tables import SECTIONS_SQL, sections, table

_Q = "tion"
_RESULTS_SQL = f"""{SECTIONS_SQL}, r AS (
  SELECT 'section' AS kind, section_id AS id, (CASE WHEN contains(lower(title), '{_Q}') THEN 10 ELSE 0 END) + (CASE WHEN contains(lower(book_id), '{_Q}') THEN 5 ELSE 0 END) + (CASE WHEN contains(lower(markdown), '{_Q}') THEN 2 ELSE 0 END) AS score, 0 AS source_order, section_id AS row_order FROM sections
  UNION ALL SELECT 'item', item_id, CASE WHEN contains(lower(text), '{_Q}') THEN 12 ELSE 0 END, 1, item_id FROM benchmark
  UNION ALL SELECT 'turn', conv_id * 1000 + turn, CASE WHEN contains(lower(text), '{_Q}') THEN 8 ELSE 0 END, 2, conv_id * 1000 + turn FROM conversations)"""


def _results(spark, sf_dir):
    one = lambda d, kind, id_, order, **w: d.select(F.lit(kind).alias("kind"), id_.cast("long").alias("id"), S.hits(_Q, **w).alias("score"), F.lit(order).alias("source_order"), id_.cast("long").alias("row_order"))
    turn = F.col("conv_id") * 1000 + F.col("turn")
    return (
        one(sections(spark, sf_dir), "section", F.col("section_id"), 0, title=("title", 10), chapter=("book_id", 5), body=("markdown", 2))
        .unionByName(one(table(spark, sf_dir, "benchmark"), "item", F.col("item_id"), 1, text=("text", 12)))
        .unionByName(one(table(spark, sf_dir, "conversations"), "turn", turn, 2, text=("text", 8)))
    )


@query(f"WITH {_RESULTS_SQL} SELECT kind, id, score FROM r WHERE score > 0 ORDER BY score DESC, source_order, row_order LIMIT 25")
def global_search_topk(spark, sf_dir):
    return S.top(_results(spark, sf_dir), 25).select("kind", "id", "score")


@query(f"WITH {_RESULTS_SQL} SELECT kind, count(*) AS total FROM r WHERE score > 0 GROUP BY 1")
def search_totals(spark, sf_dir):
    return _results(spark, sf_dir).where("score > 0").groupBy("kind").agg(F.count(F.lit(1)).alias("total"))


@query(f"""WITH t AS (SELECT item_id, trim(regexp_replace(regexp_replace(text, '[#*_>`|\\[\\]()!~-]+', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS p FROM benchmark WHERE contains(lower(text), '{_Q}')),
u AS (SELECT *, greatest(1, greatest(strpos(lower(p), '{_Q}'), 1) - 35) AS s FROM t)
SELECT item_id, (CASE WHEN s > 1 THEN '…' ELSE '' END) || substring(p, s, 74) || (CASE WHEN s + 74 <= length(p) THEN '…' ELSE '' END) AS snippet FROM u""")
def search_snippet(spark, sf_dir):
    found = table(spark, sf_dir, "benchmark").where(F.contains(F.lower("text"), F.lit(_Q)))
    return found.select("item_id", S.snippet(F.col("text"), _Q).alias("snippet"))


@query("""WITH a AS (SELECT doc_id AS id, lower(split_part(text, ' ', 1)) AS title FROM documents), b AS (SELECT item_id AS id, lower(split_part(text, ' ', 1)) AS title FROM benchmark)
SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b ON contains(a.title, b.title) OR contains(b.title, a.title) WHERE a.title <> '' AND b.title <> ''""")
def fuzzy_title_match(spark, sf_dir):
    first = lambda d, k: d.select(F.col(k).alias("id"), F.lower(F.split("text", " ")[0]).alias("title"))
    return S.contained_titles(first(table(spark, sf_dir, "documents"), "doc_id"), first(table(spark, sf_dir, "benchmark"), "item_id"))
