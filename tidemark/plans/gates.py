"""Queries over the gates of a publication: documents as sources, brands as books of chapters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import gates as G
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_TEXTS_SQL = "d AS (SELECT doc_id AS k, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), F.coalesce("text", F.lit("")).alias("text"))


def _outlines(texts):
    k, n = F.col("book_id"), F.size(F.split("text", "\n"))
    return texts.select(
        "book_id", F.when(k % 10 == 0, "x").otherwise(F.sha2("text", 256)).alias("sha256"), F.when(k % 7 == 0, 0).otherwise(n).alias("line_count"), F.lit(1).alias("start_line"), F.when(k % 9 == 0, n + 1).otherwise(n).alias("end_line"),
        F.lit("t").alias("title"), F.when(k % 4 == 0, "2").otherwise("").alias("edition"),
    )


def _lines(texts):
    return texts.select("book_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


@query(f"""WITH {_TEXTS_SQL}, e AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'other' WHEN k % 6 = 0 THEN 'edition' ELSE 'title' END AS field, CASE WHEN k % 5 = 0 THEN 'zzzz9' ELSE substr(lines[1], 1, 5) END AS quote FROM d),
s AS (SELECT *, k % 11 <> 0 AND quote <> '' AS shaped, k % 11 <> 0 AND quote <> '' AND contains(lines[1], quote) AS there FROM e)
SELECT k AS book_id, unnest(list_filter([CASE WHEN k % 10 = 0 THEN 'source_hash' END, CASE WHEN k % 7 = 0 THEN 'source_line_count' END, CASE WHEN k % 9 = 0 THEN 'content_range' END,
  CASE WHEN NOT shaped THEN 'identity_evidence_shape' END, CASE WHEN shaped AND NOT there THEN 'identity_evidence_missing' END], lambda x: x IS NOT NULL)) AS code FROM s
UNION ALL SELECT k, 'identity_evidence_required' FROM s WHERE NOT (there AND field = 'title') UNION ALL SELECT k, 'identity_evidence_required' FROM s WHERE k % 4 = 0 AND NOT (there AND field = 'edition')""")
def outline_gates(spark, sf_dir):
    texts, k = _texts(spark, sf_dir), F.col("book_id")
    first = F.split("text", "\n")[0]
    field = F.when(k % 11 == 0, "other").when(k % 6 == 0, "edition").otherwise("title")
    evidence = texts.select("book_id", F.lit(0).alias("n"), field.alias("field"), F.lit(1).alias("line"), F.when(k % 5 == 0, "zzzz9").otherwise(F.substring(first, 1, 5)).alias("quote"))
    sources = texts.select("book_id", F.sha2("text", 256).alias("actual_sha256"), F.size(F.split("text", "\n")).alias("n_lines"))
    outlines = _outlines(texts)
    return G.source_gates(outlines, sources).unionByName(G.evidence_gates(outlines, evidence, _lines(texts))).select("book_id", "code")


@query(f"""WITH {_TEXTS_SQL}, r AS (SELECT k, lines, n, CAST(1 + k % 2 AS INT) AS line, CASE WHEN n = 0 OR k % 8 = 0 THEN 'en' ELSE 'er' END AS old, CASE WHEN n = 0 THEN 1 + k % 3 ELSE 1 END AS cnt, n = 1 OR k % 13 <> 0 AS shaped FROM d, (VALUES (0), (1)) AS v(n)),
g AS (SELECT *, row_number() OVER (PARTITION BY k, line, old ORDER BY n) AS twin, line <= len(lines) + CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS inside, coalesce((length(lines[line]) - length(replace(lines[line], old, ''))) // 2, 0) AS times FROM r WHERE shaped)
SELECT k AS book_id, 'replacement_shape' AS code, CAST(n AS VARCHAR) AS place FROM r WHERE NOT shaped UNION ALL SELECT k, 'replacement_duplicate', CAST(n AS VARCHAR) FROM g WHERE twin > 1
UNION ALL SELECT k, CASE WHEN NOT inside THEN 'replacement_line' ELSE 'replacement_evidence' END, CAST(n AS VARCHAR) FROM g WHERE twin = 1 AND (NOT inside OR times <> cnt)""")
def replacement_gates(spark, sf_dir):
    texts, k, n = _texts(spark, sf_dir), F.col("book_id"), F.col("n")
    each = texts.select("book_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    rows = each.select(
        "book_id", "n", (1 + k % 2).cast("int").alias("line"), F.when((n == 0) | (k % 8 == 0), "en").otherwise("er").alias("old"), F.lit("x").alias("new"),
        F.when((n == 0) & (k % 13 == 0), " ").otherwise("seen").alias("reason"), F.when(n == 0, 1 + k % 3).alias("count"),
    )
    return G.replacement_gates(_outlines(texts), rows, _lines(texts))


@query("""WITH c AS (SELECT p_brand AS b, p_partkey AS k, p_size AS size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
l AS (SELECT b, sum(size) * 10 AS o, sum(size) * 10 - count(*) * (ascii(b[8]) % 4) * 15 AS c, sum(size) * 9 AS p FROM c GROUP BY 1)
SELECT b AS book_id, 'empty_or_too_short_chapter' AS code, CAST(k AS VARCHAR) AS place FROM c WHERE size < 20 UNION ALL SELECT DISTINCT b, 'chapter_order_gap_or_duplicate', '' FROM c WHERE k % 50 = 0
UNION ALL SELECT b, 'candidate_abnormally_short', '' FROM l WHERE c * 100 < o * 85 UNION ALL SELECT b, 'published_chapters_abnormally_short', '' FROM l WHERE p * 100 < c * 85""")
def chapter_gates(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) + F.when(k % 50 == 0, 1).otherwise(0)
    chapters = part.select(F.col("p_brand").alias("book_id"), k.alias("ord"), k.alias("chapter_id"), F.concat(F.lit("a/b/"), F.lpad(number.cast("string"), 5, "0"), F.lit("-x.md")).alias("artifact"), (F.col("p_size") * 10).alias("character_count"))
    size = F.sum("p_size").cast("long")
    lengths = part.groupBy(F.col("p_brand").alias("book_id")).agg((size * 10).alias("original"), (size * 10 - F.count(F.lit(1)) * (F.ascii(F.substring(F.first("p_brand"), 8, 1)) % 4) * 15).alias("candidate"), (size * 9).alias("published"))
    return G.chapter_gates(chapters, lengths)
