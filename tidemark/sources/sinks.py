"""Writers: grouped Markdown notes, JSON lines, and versions of a table with a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import safe_name


def notes(blocks: DataFrame, group: str, order: str, block: Column, heading: str = "# ") -> DataFrame:
    """(name, value): one Markdown text for each group, its blocks in order; name is fit for a file."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), block.alias("b")))), lambda x: x["b"])
    texts = blocks.groupBy(group).agg(parts.alias("parts"))
    body = F.concat(F.lit(heading), F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit("\n\n"), F.array_join("parts", "\n\n"), F.lit("\n"))
    return texts.select(safe_name(F.col(group).cast("string")).alias("name"), body.alias("value"))


def write_notes(texts: DataFrame, path: str) -> None:
    """A folder for each name, with its text."""
    texts.repartition("name").write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, fields in the order of columns, nulls left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def publish(rows: DataFrame, root: str, version: str, check: Column) -> int:
    """Writes a version beside the others and adds it to the history once every row passes check; a version stays as it is."""
    bad = rows.where(~F.coalesce(check, F.lit(False))).limit(1).count()
    if bad:
        raise ValueError("rows fail the check; nothing is published")
    rows.write.mode("error").parquet(f"{root}/versions/{version}")
    written = rows.sparkSession.read.parquet(f"{root}/versions/{version}")
    entry = written.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("content"))
    entry.write.mode("append").parquet(f"{root}/history")
    return written.count()


def current(spark, root: str) -> DataFrame:
    """The version published last, by its name."""
    last = spark.read.parquet(f"{root}/history").agg(F.max("version").alias("v")).first()["v"]
    return spark.read.parquet(f"{root}/versions/{last}")
