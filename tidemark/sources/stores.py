"""Study stores as tables: JSON documents, JSON lines and Markdown notes, read by Spark.

Published questions fail on a malformed line; all other stores are tolerant, with defaults
for what is missing or of a wrong type. A path that does not exist is an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTION = (
    "question_id string, bank_id string, question_type string, difficulty string, scope string, unit string, unit_key string, local_number int, stem_md string, context_md string, "
    "options array<struct<label:string,text_md:string>>, correct_answers array<string>, knowledge_ids array<string>, source_refs array<struct<source_id:string,block_id:string>>, "
    "source_analysis_md string, status string"
)
ACTIVITY = (
    "activity_id string, activity_type string, domain string, subject_id string, resource_id string, item_id string, started_at string, last_active_at string, duration_seconds bigint, "
    "result_state string, output_refs array<struct<kind:string,id:string,path:string>>, idempotency_keys array<string>"
)


def _json(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    try:
        return spark.read.schema(schema).options(**{"multiLine": True, "mode": "PERMISSIVE", **options}).json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Ready questions with an id, from JSON lines; a malformed line fails the job."""
    return spark.read.schema(QUESTION).option("mode", "FAILFAST").json(path).where("status = 'ready' AND question_id IS NOT NULL")


def activities(spark: SparkSession, path: str) -> DataFrame:
    """Activities of a store {days: {date: {activities: [...]}}}; keys that are no dates go."""
    days = _json(spark, path, f"days map<string,struct<activities:array<struct<{_fields(ACTIVITY)}>>>>")
    rows = days.select(F.explode("days").alias("date", "day")).where(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    return rows.select(F.to_date("date").alias("date"), F.posexplode("day.activities").alias("ord", "a")).select("date", "ord", "a.*").withColumn("duration_seconds", F.greatest(F.lit(0), F.coalesce("duration_seconds", F.lit(0))))


def _fields(ddl: str) -> str:
    out, depth = "", 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        out += ":" if c == " " and not depth and out and out[-1] not in ", " else c
    return out


def keyed(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(id, value.*) of a store {items: {id: {...}}}. value: DDL of the fields."""
    return _json(spark, path, f"items map<string,struct<{_fields(value)}>>").select(F.explode("items").alias("id", "v")).select("id", "v.*")


def recall_items(spark: SparkSession, path: str) -> DataFrame:
    """Cards of subjects of chapters, flattened in order; a repeated id fails the job."""
    item = "id:string,type:string,title:string,star_level:int,answer_markdown:string,`order`:int"
    rows = _json(spark, path, f"subjects array<struct<id:string,chapters:array<struct<id:string,title:string,`order`:int,items:array<struct<{item}>>>>>>")
    rows = rows.select(F.explode("subjects").alias("s")).select(F.col("s.id").alias("subject_id"), F.explode("s.chapters").alias("c"))
    rows = rows.select("subject_id", F.col("c.id").alias("chapter_id"), F.col("c.order").alias("chapter_order"), F.explode("c.items").alias("i")).select("subject_id", "chapter_id", "chapter_order", "i.*")
    n = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return rows.withColumn("id", F.when(n == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("repeated id: "), F.coalesce("id", F.lit("null"))))))


def books(spark: SparkSession, path: str) -> DataFrame:
    """Manifests of ready books without blockers, of schema 1 or 2, in the order of their paths."""
    schema = "schema_version int, book struct<id:string,title:string,domain:string,subject:string>, status string, quality struct<status:string,blocker_count:int>, toc array<struct<id:string,title:string,`order`:int,section_ids:array<string>>>"
    rows = _json(spark, path, schema, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    ok = F.col("schema_version").isin(1, 2) & (F.col("status") == "ready") & (F.coalesce("quality.blocker_count", F.lit(0)) == 0) & (F.size("toc") > 0) & F.col("book.id").rlike("^[a-z0-9][a-z0-9-]{2,63}$")
    subject = F.coalesce(F.nullif(F.trim("book.subject"), F.lit("")), F.col("book.title"))
    return rows.where(ok).select(F.col("book.id").alias("id"), F.col("book.title").alias("title"), F.col("book.domain").alias("domain"), subject.alias("subject"), "toc", "path")


def toc(books: DataFrame, sections: DataFrame) -> DataFrame:
    """Chapters in order with their known sections in order; chapters without any go. sections: (book_id, section_id)."""
    chapters = books.select(F.col("id").alias("book_id"), F.explode("toc").alias("c")).select("book_id", F.col("c.id").alias("chapter_id"), F.col("c.title").alias("chapter_title"), F.col("c.order").alias("chapter_order"), F.posexplode("c.section_ids").alias("section_order", "section_id"))
    return chapters.join(sections.select("book_id", "section_id"), ["book_id", "section_id"], "left_semi")


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(key, markdown, modified_at): one row for each non-blank Markdown file, without a byte order mark and the last line end."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path)
    body = F.regexp_replace("value", "^\\uFEFF", "")
    key = F.regexp_extract(F.url_decode("_metadata.file_name"), r"^(.*)\.md$", 1)
    return rows.select(key.alias("key"), body.alias("markdown"), F.col("_metadata.file_modification_time").alias("modified_at")).where(F.length(F.regexp_replace("markdown", r"(?U)\s+", "")) > 0)


def preferred(copies: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first copy of each key in the given order: a vault's before a local one, a canonical name before an alias."""
    return copies.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def settings(spark: SparkSession, path: str, defaults: Mapping[str, float], limits: Mapping[str, tuple[float, float]]) -> DataFrame:
    """One row: each field of the file or its default, within its limits."""
    rows = _json(spark, path, ", ".join(f"{k} double" for k in defaults))
    one = spark.range(1).join(rows.limit(1), F.lit(True), "left")
    clamp = lambda k, c: F.greatest(F.lit(float(limits[k][0])), F.least(F.lit(float(limits[k][1])), c)) if k in limits else c
    return one.select(*[clamp(k, F.coalesce(k, F.lit(float(v)))).alias(k) for k, v in defaults.items()])


def signature(spark: SparkSession, path: str) -> DataFrame:
    """One row: a hash over (path, size, time) of all files, which changes when any of them does."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    parts = F.array_sort(F.collect_list(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime"))))
    return meta.agg(F.sha2(F.array_join(parts, "\n"), 256).alias("signature"), F.count(F.lit(1)).alias("files"))
