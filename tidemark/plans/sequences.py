"""Queries of machines over ordered lines. Lines of documents carry numbers made of their lengths; events of a user are numbered markers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import sequences as Q
from tidemark.operators.documents import lines
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_LINES_SQL = """raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
lines AS (SELECT doc_id, line_no, CASE WHEN line_no % 23 = 0 THEN '二、' || line WHEN length(line) % 3 = 0 THEN (1 + length(line) % 5) || '. ' || line ELSE line END AS line FROM raw),
marks AS (SELECT doc_id, line_no, line, CASE WHEN regexp_matches(line, '^\\s*([一二三四五六七八九十百〇零]+)\\s*[、.．]\\s*(.+?)\\s*$') THEN 0 WHEN regexp_matches(line, '^\\s*(\\d{1,3})\\s*[.．、]\\s*([^\\s\\d].*?)\\s*$') THEN CAST(regexp_extract(line, '^\\s*(\\d{1,3})', 1) AS INT) END AS number FROM lines)""".replace("\\\\", "\\")

_ITEMS_SQL = """o AS (SELECT m.doc_id, m.line_no, line, m.number, asked FROM marks m LEFT JOIN a ON a.doc_id = m.doc_id AND a.line_no = m.line_no),
s AS (SELECT *, max(CASE WHEN number = 0 THEN line_no END) OVER w AS chapter_at, max(CASE WHEN asked THEN line_no END) OVER w AS start FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, start, max(chapter_at) AS chapter_at, max(number) FILTER (line_no = start) AS number, max(regexp_extract(line, '^\\s*(\\d{1,3})\\s*[.．、]\\s*([^\\s\\d].*?)\\s*$', 2)) FILTER (line_no = start) AS title,
  count(*) FILTER (line_no > start AND trim(line, ' ') <> '') AS n_lines, CAST(coalesce(sum(length(trim(line, ' '))) FILTER (line_no > start), 0) AS BIGINT) AS answer_chars
FROM s WHERE start IS NOT NULL AND start > coalesce(chapter_at, 0) GROUP BY 1, 2""".replace("\\\\", "\\")


def _lines(spark, sf_dir):
    n, size = F.col("line_no"), F.length("line")
    marked = F.when(n % 23 == 0, F.concat(F.lit("二、"), "line")).when(size % 3 == 0, F.concat((1 + size % 5).cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))
    return lines(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", n.cast("long").alias("line_no"), marked.alias("line"))


@query(f"""WITH RECURSIVE {_LINES_SQL}, k AS (SELECT doc_id, line_no, number, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM marks WHERE number IS NOT NULL),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS i, 1 AS e, CAST(0 AS BIGINT) AS line_no, false AS asked FROM documents UNION ALL SELECT k.doc_id, k.i, CASE WHEN number = 0 THEN 1 WHEN number = e THEN e + 1 ELSE e END, k.line_no, number > 0 AND number = e FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + 1),
a AS (SELECT doc_id, line_no, asked FROM r), {_ITEMS_SQL}""")
def numbered_questions(spark, sf_dir):
    return Q.numbered_items(_lines(spark, sf_dir), "doc_id", "line_no", "line")


@query(f"WITH {_LINES_SQL}, a AS (SELECT doc_id, line_no, number > 0 AS asked FROM marks WHERE number IS NOT NULL), {_ITEMS_SQL}")
def numbered_definitions(spark, sf_dir):
    return Q.numbered_items(_lines(spark, sf_dir), "doc_id", "line_no", "line", consecutive=False)


_MARKERS_SQL = """m AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) + CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS total FROM events),
x AS (SELECT user_id, event_id, total, CASE WHEN k % 9 = 0 THEN NULL WHEN k % 13 = 0 AND n > 9 THEN n % 10 WHEN k % 31 = 0 THEN 3 ELSE n END AS n FROM m)"""


def _markers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    own = Window.partitionBy("user_id")
    n = F.row_number().over(own.orderBy("event_id")).cast("long")
    e = e.withColumn("n", n).withColumn("total", F.count(F.lit(1)).over(own) + F.when(F.col("user_id") % 3 == 0, 1).otherwise(0))
    seen = F.when(F.col("k") % 9 == 0, None).when((F.col("k") % 13 == 0) & (F.col("n") > 9), F.col("n") % 10).when(F.col("k") % 31 == 0, F.lit(3)).otherwise(F.col("n"))
    return e.select("user_id", "event_id", "total", seen.alias("n"))


@query(f"""WITH {_MARKERS_SQL}, t AS (SELECT *, CASE WHEN n > coalesce(max(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN n END AS known FROM x),
g AS (SELECT *, coalesce(max(known) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS low, coalesce(min(known) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), total + 1) AS high FROM t),
f AS (SELECT *, CASE WHEN known IS NULL AND high - low - 1 = count(*) FILTER (known IS NULL) OVER (PARTITION BY user_id, low, high) THEN low + count(*) FILTER (known IS NULL) OVER (PARTITION BY user_id, low, high ORDER BY event_id) END AS filled FROM g)
SELECT user_id, event_id, n, CASE WHEN known IS NOT NULL THEN n WHEN n IS NULL OR CAST(filled AS VARCHAR) LIKE '%' || n THEN filled END AS found,
  CASE WHEN known IS NOT NULL THEN NULL WHEN filled IS NULL THEN 'ambiguous' WHEN n IS NULL THEN 'missing' WHEN CAST(filled AS VARCHAR) LIKE '%' || n THEN 'truncated' ELSE 'conflict' END AS reason FROM f""")
def recovered_ordinals(spark, sf_dir):
    return Q.recovered_numbers(_markers(spark, sf_dir), "user_id", "event_id", "n", "total")


@query(f"WITH {_MARKERS_SQL} SELECT user_id, count(*) AS markers, max(total) AS expected FROM x GROUP BY 1 HAVING count(*) <> max(total)")
def ordinal_totals(spark, sf_dir):
    return Q.number_totals(_markers(spark, sf_dir), "user_id", "total")


_ANCHORS = ("the", "on", "ing", "ed")
_STEPS = ",\n".join(f"c{i} AS (SELECT c.*, (SELECT min(line_no) FROM l WHERE l.doc_id = c.doc_id AND line_no > c.at{i - 1} AND contains(line, '{a}')) AS at{i} FROM c{i - 1} c)" for i, a in enumerate(_ANCHORS, 1))
_CHAIN_SQL = f"""l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
c0 AS (SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS at0 FROM l),
{_STEPS}, chain AS ({" UNION ALL ".join(f"SELECT doc_id, {i} AS step, '{a}' AS anchor, at{i} AS pos FROM c{len(_ANCHORS)}" for i, a in enumerate(_ANCHORS, 1))})"""


def _chain(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    return Q.anchor_chain(rows, "doc_id", "line_no", "line", _ANCHORS), rows


@query(f"WITH {_CHAIN_SQL}, e AS (SELECT doc_id, max(line_no) + 1 AS past FROM l GROUP BY 1), s AS (SELECT doc_id, step, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY step), past) AS nxt FROM chain JOIN e USING (doc_id) WHERE pos IS NOT NULL), t AS (SELECT *, CAST(sum(nxt - pos + 1) OVER (PARTITION BY doc_id ORDER BY step) AS BIGINT) AS out_end FROM s) SELECT doc_id, step, pos AS start, nxt AS \"end\", out_end - (nxt - pos) AS out_start, out_end FROM t")
def anchored_slices(spark, sf_dir):
    chain, rows = _chain(spark, sf_dir)
    return Q.anchor_slices(chain, rows.groupBy("doc_id").agg((F.max("line_no") + 1).alias("end")), "doc_id")


@query(f"WITH {_CHAIN_SQL} SELECT doc_id, min(step) AS step, 'anchor_missing' AS code FROM chain WHERE pos IS NULL GROUP BY 1")
def missing_anchors(spark, sf_dir):
    chain, _ = _chain(spark, sf_dir)
    return chain.where("at IS NULL").groupBy("doc_id").agg(F.min("step").alias("step"), F.lit("anchor_missing").alias("code"))
