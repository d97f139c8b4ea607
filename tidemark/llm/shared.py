"""Column clean-up and batch sizes used by the operators; the shared folder and written tables are those of all operators."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import shared_dir, written  # noqa: F401

ROWS_PER_BATCH = 500


def texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id long, text string); all other columns go. A table without rows or with null texts is fine."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column: sizes shards and blocks, so that they follow the data."""
    return int(df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def bounded(f):
    """f with Arrow batches of ROWS_PER_BATCH rows at most: the default holds 10,000 texts at once, twice in each task."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        now = int(spark.conf.get(key))
        spark.conf.set(key, str(min(ROWS_PER_BATCH, now) if now > 0 else ROWS_PER_BATCH))
        return f(spark, *args)

    return run
