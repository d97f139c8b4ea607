"""Queries for reviews and inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import review as V
from tidemark.plans.registry import query
from tidemark.sources.tables import ACTIVITIES_SQL, activities, table


@query(f"""WITH {ACTIVITIES_SQL}, t AS (SELECT * FROM activities WHERE date = (SELECT max(date) FROM activities)),
s AS (SELECT domain AS subject, 0 AS characters, duration_seconds AS seconds, ord AS position FROM t UNION ALL SELECT t.domain, d.n_chars, 0, ord + 1000000 FROM t JOIN documents d ON d.doc_id = CAST(t.item_id AS BIGINT)),
g AS (SELECT subject, count(*) AS sources, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(seconds) AS BIGINT) AS seconds, bool_or(seconds > 0) AS tracked, min(position) AS position FROM s GROUP BY 1)
SELECT subject, sources, characters, seconds, tracked, CAST(row_number() OVER (ORDER BY position, subject) AS INT) AS ordinal FROM g""")
def review_subject_groups(spark, sf_dir):
    a = activities(spark, sf_dir)
    today = a.join(F.broadcast(a.agg(F.max("date").alias("date"))), "date")
    timed = today.select(F.col("domain").alias("subject"), F.lit("activity").alias("kind"), F.col("activity_id").alias("id"), F.lit(0).cast("long").alias("characters"), F.col("duration_seconds").alias("seconds"), F.col("ord").alias("position"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    read = today.join(docs, F.col("item_id").cast("long") == F.col("doc_id")).select(
        F.col("domain").alias("subject"), F.lit("section").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("characters"), F.lit(0).cast("long").alias("seconds"), (F.col("ord") + 1000000).alias("position")
    )
    return V.subject_groups(V.sources(timed, read))


@query(f"""WITH {ACTIVITIES_SQL}, i AS (SELECT DISTINCT date, 'item' AS field, item_id AS id FROM activities UNION SELECT DISTINCT date, 'resource', resource_id FROM activities)
SELECT CAST(date AS VARCHAR) AS date, field, count(*) AS missing FROM i WHERE id NOT IN (SELECT CAST(item_id AS VARCHAR) FROM benchmark) GROUP BY 1, 2""")
def unarchived_ids(spark, sf_dir):
    a = activities(spark, sf_dir)
    ids = a.select("date", F.lit("item").alias("field"), F.col("item_id").alias("id")).unionByName(a.select("date", F.lit("resource").alias("field"), F.col("resource_id").alias("id")))
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"))
    return V.unarchived(ids, known).withColumn("date", F.col("date").cast("string"))


@query("SELECT source, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS characters, count(*) FILTER (trim(text) = '') AS blank, count(DISTINCT sha256(text)) AS contents FROM documents GROUP BY 1")
def content_inventory(spark, sf_dir):
    return V.inventory(table(spark, sf_dir, "documents").select("source", "text"), "source")
