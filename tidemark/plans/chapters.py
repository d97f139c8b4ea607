"""Queries of outlines by tiers, repaired headings, carved pages, attached ids, signatures and chunks of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import chapters as C
from tidemark.operators.documents import lines
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_RAW_SQL = "raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents)"
_HEADED_SQL = f"""{_RAW_SQL}, lines AS (SELECT doc_id, line_no, CASE WHEN line_no % 9 = 5 THEN '```' WHEN line_no = 2 AND doc_id % 3 = 0 THEN '# Doc ' || doc_id WHEN line_no % 4 = 3 AND doc_id % 5 = 1 THEN '### 考点 ' || line_no % 8 || ' ' || left(line, 3) WHEN line_no % 4 = 3 AND doc_id % 5 = 2 THEN '## 二、' || left(line, 3) WHEN line_no % 5 = 4 THEN '## 第一章 ' || line WHEN line_no % 3 = 1 THEN repeat('#', 1 + CAST((line_no + doc_id) % 3 AS INT)) || ' ' || left(line, 2) || ' #' ELSE line END AS line FROM raw)"""


def _headed(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    n, d, line = F.col("line_no"), F.col("doc_id"), F.col("line")
    marked = (
        F.when(n % 9 == 5, "```").when((n == 2) & (d % 3 == 0), F.concat(F.lit("# Doc "), d.cast("string"))).when((n % 4 == 3) & (d % 5 == 1), F.concat(F.lit("### 考点 "), (n % 8).cast("string"), F.lit(" "), F.left(line, F.lit(3))))
        .when((n % 4 == 3) & (d % 5 == 2), F.concat(F.lit("## 二、"), F.left(line, F.lit(3)))).when(n % 5 == 4, F.concat(F.lit("## 第一章 "), line))
        .when(n % 3 == 1, F.concat(F.repeat(F.lit("#"), (1 + (n + d) % 3).cast("int")), F.lit(" "), F.left(line, F.lit(2)), F.lit(" #"))).otherwise(line)
    )
    return rows.select("doc_id", n.cast("long").alias("line_no"), marked.alias("line"))


@query(rf"""WITH {_HEADED_SQL}, f AS (SELECT *, NOT starts_with(line, '```') AND sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) % 2 = 0 AS outside FROM lines),
g AS (SELECT doc_id, line_no, regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 1) AS marks, trim(regexp_extract(line, '^(#{{1,6}})\s+(.+?)\s*#*\s*$', 2)) AS title FROM f WHERE outside), h AS (SELECT *, lower(regexp_replace(translate(title, '：，！？（）［］．', ':,!?()[].'), '[*_`~#\s·•:,。.!?()\[\]【】]+', '', 'g')) AS same, 'doc' || doc_id AS own FROM g WHERE marks <> ''),
b AS (SELECT *, min(CASE WHEN same = own THEN line_no END) OVER (PARTITION BY doc_id) AS begins FROM h), c AS (SELECT *, regexp_matches(title, '(?i)^考点\s*\d+') AS point, regexp_matches(title, '^[一二三四五六七八九十百]+[、.．]\s*') AS major FROM b WHERE (begins IS NULL OR line_no > begins) AND title <> '' AND same <> own AND NOT regexp_matches(title, '^第[一二三四五六七八九十百零〇\d]+章|^>{{0,2}}\s*导言$')),
t AS (SELECT doc_id, CASE WHEN count(*) FILTER (point) >= 2 THEN 'point' WHEN count(*) FILTER (major) >= 2 THEN 'major' WHEN count(*) >= 2 THEN 'level' END AS tier, min(length(marks)) AS shallowest FROM c GROUP BY 1)
SELECT doc_id, line_no, length(marks) AS level, title, tier FROM c JOIN t USING (doc_id) WHERE ((tier = 'point' AND point) OR (tier = 'major' AND major) OR (tier = 'level' AND length(marks) = shallowest)) AND same <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, same ORDER BY line_no) = 1""")
def section_guides(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))
    return C.section_guides(_headed(spark, sf_dir), titles, "doc_id")


@query(rf"""WITH {_RAW_SQL}, l AS (SELECT doc_id, line_no, trim(CASE WHEN line_no % 6 = 1 THEN '## 第' WHEN line_no % 6 = 2 AND doc_id % 2 = 0 THEN ' ' WHEN line_no % 6 = 3 THEN '## 段原文' WHEN line_no % 6 = 5 THEN '## 第 ' || line_no % 4 || ' 段原文' ELSE line END, ' ') AS old FROM raw),
n AS (SELECT *, lead(old) OVER w AS following, lag(old) OVER w AS before FROM l WHERE old <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), m AS (SELECT *, coalesce(old = '## 段原文' AND before = '## 第', false) AS second, coalesce(old = '## 第' AND following = '## 段原文', false) AS first FROM n),
k AS (SELECT *, first OR (regexp_matches(old, '^##\s*(?:第\s*)?(\d+)?\s*段原文\s*$') AND NOT second) AS heads FROM m), r AS (SELECT *, CASE WHEN second THEN '' ELSE '## 第' || count(*) FILTER (heads) OVER (PARTITION BY doc_id ORDER BY line_no) || '段原文' END AS new FROM k)
SELECT doc_id, line_no, old, new FROM r WHERE (second OR heads) AND old <> new""")
def heading_repairs(spark, sf_dir):
    rows = lines(table(spark, sf_dir, "documents"), "doc_id", "text")
    n = F.col("line_no")
    line = F.when(n % 6 == 1, "## 第").when((n % 6 == 2) & (F.col("doc_id") % 2 == 0), " ").when(n % 6 == 3, "## 段原文").when(n % 6 == 5, F.concat(F.lit("## 第 "), (n % 4).cast("string"), F.lit(" 段原文"))).otherwise(F.col("line"))
    return C.heading_repairs(rows.select("doc_id", n.cast("long").alias("line_no"), line.alias("line")), "doc_id", "## 第", "## 段原文")


_PAGES_SQL = "p AS (SELECT l_orderkey AS book, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem), q AS (SELECT book, n * 10 - 9 AS start, n * 10 AS \"end\", CASE WHEN n % 3 = 0 THEN 'exercise' ELSE 'reading' END AS role FROM p), c AS (SELECT o_orderkey AS book, CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 8 END AS a, CASE o_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 6 ELSE 10 END AS b FROM orders WHERE o_custkey % 4 > 0)"


@query(f"""WITH {_PAGES_SQL}, s AS (SELECT q.book, start, a - 1 AS e, role FROM q JOIN c ON c.book = q.book AND a >= start AND b <= "end" UNION ALL SELECT c.book, a, b, 'reference' FROM q JOIN c ON c.book = q.book AND a >= start AND b <= "end" UNION ALL SELECT q.book, b + 1, "end", role FROM q JOIN c ON c.book = q.book AND a >= start AND b <= "end"
UNION ALL SELECT book, start, "end", role FROM q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.book = q.book AND a >= start AND b <= "end")) SELECT book, start, e AS "end", role, row_number() OVER (PARTITION BY book ORDER BY start) AS "order" FROM s WHERE start <= e""")
def carved_pages(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).cast("long")
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book"), n.alias("n")).select("book", (F.col("n") * 10 - 9).alias("start"), (F.col("n") * 10).alias("end"), F.when(F.col("n") % 3 == 0, "exercise").otherwise("reading").alias("role"))
    k = F.col("o_custkey")
    at = lambda a, b, c: F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise(c).cast("long")
    cuts = table(spark, sf_dir, "orders").where(k % 4 > 0).select(F.col("o_orderkey").alias("book"), at(1, 4, 8).alias("cut_start"), at(3, 6, 10).alias("cut_end"))
    return C.carved(pages, cuts, "book").withColumn("order", F.col("order").cast("long"))


@query("""WITH e AS (SELECT ps.p_partkey AS place, 'k' || ps.p_partkey % 9 AS id, unnest([ps.p_partkey % 300, ps.p_partkey * 7 % 300, ps.p_partkey % 300]) AS page, generate_subscripts([1, 2, 3], 1) AS i FROM part ps),
s AS (SELECT page, string_agg(id, ',' ORDER BY place, i) AS ids FROM e GROUP BY 1) SELECT s_suppkey AS section_id, coalesce(ids, '') AS knowledge_ids FROM supplier LEFT JOIN s ON page = s_suppkey""")
def attached_ids(spark, sf_dir):
    k = F.col("p_partkey")
    entries = table(spark, sf_dir, "part").select(k.alias("place"), F.concat(F.lit("k"), (k % 9).cast("string")).alias("id"), F.array(k % 300, k * 7 % 300, k % 300).alias("page_ids"))
    rows = C.attached_ids(entries, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("section_id")))
    return rows.select("section_id", F.array_join("knowledge_ids", ",").alias("knowledge_ids"))


@query("""WITH l AS (SELECT doc_id || '|' || coalesce(source, '') || '|' || coalesce(CAST(n_chars AS VARCHAR), '') AS line FROM documents), s AS (SELECT left(sha256(line), 3) AS share, sha256(string_agg(line, chr(10) ORDER BY line)) AS h, count(*) AS n FROM l GROUP BY 1)
SELECT sha256(string_agg(share || ':' || h, chr(10) ORDER BY share)) AS signature, CAST(sum(n) AS BIGINT) AS n FROM s""")
def catalog_signature(spark, sf_dir):
    return C.signature(table(spark, sf_dir, "documents"), ["doc_id", "source", "n_chars"])


_CHUNKS_SQL = """d AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id, text FROM documents), c AS (SELECT book, (n - 1) * 4 + CASE WHEN doc_id % 97 = 3 THEN 1 ELSE 0 END AS a, n * 4 - 1 - CASE WHEN doc_id % 89 = 5 THEN 6 ELSE 0 END AS b, text FROM d UNION ALL SELECT book, (n - 1) * 4, n * 4 - 1, text FROM d WHERE doc_id % 101 = 7),
t AS (SELECT book, max(n) * 4 + CASE WHEN length(book) % 7 = 0 THEN 1 ELSE 0 END AS pages FROM d GROUP BY 1), r AS (SELECT book, a, b, count(*) AS files FROM c GROUP BY 1, 2, 3), s AS (SELECT *, coalesce(max(b) OVER (PARTITION BY book ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0) AS due FROM r),
f AS (SELECT book, a AS first, 'chunk_twin' AS code FROM s WHERE files > 1 UNION ALL SELECT book, a, 'range_backwards' FROM s WHERE b < a UNION ALL SELECT book, a, 'range_gap' FROM s WHERE a > due UNION ALL SELECT book, a, 'range_overlap' FROM s WHERE a < due UNION ALL SELECT t.book, NULL, 'page_total' FROM t LEFT JOIN (SELECT book, max(b) + 1 AS past FROM r GROUP BY 1) m USING (book) WHERE past IS DISTINCT FROM pages)"""


def _chunks(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("n"), "doc_id", "text")
    k, n = F.col("doc_id"), F.col("n")
    rows = d.select("book", ((n - 1) * 4 + F.when(k % 97 == 3, 1).otherwise(0)).alias("first"), (n * 4 - 1 - F.when(k % 89 == 5, 6).otherwise(0)).alias("last"), "text")
    rows = rows.unionByName(d.where(k % 101 == 7).select("book", ((n - 1) * 4).alias("first"), (n * 4 - 1).alias("last"), "text"))
    totals = d.groupBy("book").agg((F.max("n") * 4 + F.when(F.length("book") % 7 == 0, 1).otherwise(0)).alias("pages"))
    return rows, totals


@query(f"WITH {_CHUNKS_SQL} SELECT * FROM f")
def chunk_findings(spark, sf_dir):
    return C.chunk_findings(*_chunks(spark, sf_dir))


@query(rf"""WITH {_CHUNKS_SQL}, g AS (SELECT book, a, '<!-- source-pdf-pages: ' || a + 1 || '-' || b + 1 || ' -->' || chr(10) || chr(10) || regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x0B]+', ''), '[\s\x0B]+$', '') AS t FROM c WHERE book NOT IN (SELECT book FROM f))
SELECT book, row_number() OVER w AS place, sha256(t) AS text_sha256, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY book ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM g WINDOW w AS (PARTITION BY book ORDER BY a)""")
def assembled_chunks(spark, sf_dir):
    rows, totals = _chunks(spark, sf_dir)
    return C.assembled(rows, C.chunk_findings(rows, totals)).select("book", "place", F.sha2("text", 256).alias("text_sha256"), "offset")
