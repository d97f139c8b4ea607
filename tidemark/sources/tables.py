"""The driver's tables as the study model: activities, sections, attempts, questions, turns.

A study store of one's own needs the same columns only; nothing else in the library
knows where they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"view": "read", "click": "objective_practice", "signup": "notebook", "error": "subjective_practice", "purchase": "review"}
DOMAINS = ("medicine", "politics", "english")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each activity event; ord is its order of arrival."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    domain = F.when(F.col("user_id") % 4 == 3, "art").otherwise(F.element_at(F.array(*map(F.lit, DOMAINS)), (F.least(F.col("user_id") % 4, F.lit(2)) + 1).cast("int")))
    return e.select(
        F.col("event_id").alias("ord"), F.to_date("ts").alias("date"), F.concat(F.lit("act-"), "event_id").alias("activity_id"), kind[F.col("event_type")].alias("activity_type"),
        domain.alias("domain"), F.concat(F.lit("res-"), "user_id").alias("resource_id"), F.get_json_object("props", "$.k").alias("item_id"),
        F.floor("value").cast("long").alias("duration_seconds"), F.col("ts").alias("last_active_at"),
        F.when(F.col("event_type") == "purchase", "has_output").when(F.col("event_type") == "signup", "completed").otherwise("in_progress").alias("result_state"),
        F.when(F.col("event_type") == "purchase", F.array(F.concat(F.lit("out-"), (F.col("user_id") % 10)))).otherwise(F.array().cast("array<string>")).alias("output_refs"),
        F.col("props"),
    )


ACTIVITIES_SQL = """activities AS (
  SELECT event_id AS ord, CAST(ts AS DATE) AS date, 'act-' || event_id AS activity_id,
    CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'objective_practice' WHEN 'signup' THEN 'notebook' WHEN 'error' THEN 'subjective_practice' ELSE 'review' END AS activity_type,
    CASE user_id % 4 WHEN 0 THEN 'medicine' WHEN 1 THEN 'politics' WHEN 2 THEN 'english' ELSE 'art' END AS domain,
    'res-' || user_id AS resource_id, json_extract_string(props, '$.k') AS item_id,
    CAST(floor(value) AS BIGINT) AS duration_seconds, ts AS last_active_at,
    CASE event_type WHEN 'purchase' THEN 'has_output' WHEN 'signup' THEN 'completed' ELSE 'in_progress' END AS result_state,
    CASE WHEN event_type = 'purchase' THEN 'out-' || (user_id % 10) END AS output_ref, props
  FROM events)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sections of books: a book for each source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("section_id"), F.col("source").alias("book_id"), F.col("lang").alias("domain"),
        F.substring(F.split(F.coalesce("text", F.lit("")), "\n")[0], 1, 40).alias("title"), F.coalesce("text", F.lit("")).alias("markdown"), F.col("n_chars").alias("character_count"),
    )


SECTIONS_SQL = """sections AS (
  SELECT doc_id AS section_id, source AS book_id, lang AS domain, substring(split_part(coalesce(text, ''), chr(10), 1), 1, 40) AS title,
    coalesce(text, '') AS markdown, n_chars AS character_count
  FROM documents)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as the last answers to questions."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 1).alias("previously_wrong"))


ATTEMPTS_SQL = "attempts AS (SELECT doc_id AS question_id, quality = 1 AS correct, toxic = 1 AS previously_wrong FROM labels)"


def as_of(df: DataFrame, column: str = "date") -> DataFrame:
    """One row with the last day of df, for queries relative to a day."""
    return df.agg(F.max(column).alias("as_of"))
