"""Changes of study records: toggles, defaults, fan-outs and the backfill of an old schema. Ids follow from content, so that a second run changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.study import joined_id


def resolved_by_hand(attempts: DataFrame, asked: DataFrame) -> DataFrame:
    """attempts (question_id, resolved) after the toggles of asked (question_id, resolved); questions not asked about stay."""
    return attempts.join(asked.withColumnRenamed("resolved", "now"), "question_id", "left").withColumn("resolved", F.coalesce("now", "resolved")).drop("now")


def mastery(given: Column, answer: Column, note: Column) -> Column:
    """unseen becomes learning once a text is there."""
    written = (F.coalesce(F.trim(answer), F.lit("")) != "") | (F.coalesce(F.trim(note), F.lit("")) != "")
    return F.when((F.coalesce(given, F.lit("unseen")) == "unseen") & written, "learning").otherwise(F.coalesce(given, F.lit("unseen")))


def review_activities(reviews: DataFrame) -> DataFrame:
    """One completed activity for each subject of a review (date, subjects)."""
    rows = reviews.select("date", F.explode(F.array_distinct("subjects")).alias("subject_id"))
    return rows.select(joined_id(F.lit("review"), F.col("date").cast("string"), F.col("subject_id")).alias("activity_id"), "date", F.lit("review").alias("activity_type"), "subject_id", F.lit("completed").alias("result_state"))


def vocab_activities(vocab: DataFrame) -> DataFrame:
    """A derived activity for each day (date, words_count) with words."""
    rows = vocab.where("words_count > 0")
    return rows.select(joined_id(F.lit("vocab"), F.col("date").cast("string")).alias("activity_id"), "date", F.lit("notebook").alias("activity_type"), F.lit("vocab").alias("subject_id"), F.lit("has_output").alias("result_state"))


def backfill(days: DataFrame, activities: DataFrame) -> DataFrame:
    """activities with what days of the old schema add, each once however often it runs.

    days (date, section_seconds map, notes array, review_saved): a read activity for each section with seconds, a notebook
    one for each note, a review one for a saved review. activities has the same columns as the result.
    """
    made = lambda df, kind, item, seconds, state: df.select(
        joined_id(F.lit("legacy"), F.lit(kind), F.col("date").cast("string"), item).alias("activity_id"), "date", F.lit(kind).alias("activity_type"), item.alias("item_id"), seconds.cast("long").alias("duration_seconds"), F.lit(state).alias("result_state")
    )
    read = days.select("date", F.explode("section_seconds").alias("item", "seconds")).where("seconds > 0")
    noted = days.select("date", F.explode(F.array_distinct("notes")).alias("item"))
    new = made(read, "read", F.col("item"), F.col("seconds"), "in_progress").unionByName(made(noted, "notebook", F.col("item"), F.lit(0), "has_output"))
    new = new.unionByName(made(days.where("review_saved"), "review", F.lit("day"), F.lit(0), "completed"))
    return activities.unionByName(new.join(activities.select("activity_id"), "activity_id", "left_anti").select(*activities.columns))
