"""A training-data pipeline over documents: each stage works on all that the one before kept.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents; the last returns each document's ids.

SQL can express neither the learnt scores nor BPE, so there is no oracle; the tests hold
the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bitmap import without
from tidemark.llm.bpe import encode_and_decode
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.jaccard import near_copies
from tidemark.llm.repeats import drop_repeats
from tidemark.llm.shared import bounded, written
from tidemark.llm.toxicity import score


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, and those without an id."""
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, written(scored.where("predicted = 1").select("doc_id").distinct()), "doc_id")


@bounded
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id."""
    found = near_copies(docs)
    return without(docs, written(found.where("component_id != doc_id").select("doc_id").distinct()), "doc_id")


@bounded
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; those of which nothing is left go."""
    cut = drop_repeats(docs).where("n_removed = 0 OR n_words > n_removed")
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.withColumns(changed).select(*docs.columns)


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("NOT contaminated").select(*docs.columns)


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_and_decode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each_group),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
