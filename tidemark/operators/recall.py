"""Spaced recall: what is due, the funnel of mastery, and the schedule of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEARNING_AHEAD = "INTERVAL 2 HOURS"
DAYS = {"learning": 1, "fuzzy": 2, "mastered": 4}


def is_due(now: Column) -> Column:
    """Seen, and without a next review, or with one that has come; what is being learnt comes up two hours early."""
    soon = F.col("mastery").isin("learning", "fuzzy") & (F.col("next_review_at") <= now + F.expr(LEARNING_AHEAD))
    return (F.col("mastery") != "unseen") & (F.col("next_review_at").isNull() | (F.col("next_review_at") <= now) | soon)


def due(progress: DataFrame, now: Column, most: int) -> DataFrame:
    """The first due items: learning, then fuzzy, then the rest; by next review, those without one first."""
    rank = F.when(F.col("mastery") == "learning", 0).when(F.col("mastery") == "fuzzy", 1).otherwise(2)
    return progress.where(is_due(now)).orderBy(rank, F.asc_nulls_first("next_review_at"), "item_id").limit(most)


def due_counts(progress: DataFrame, now: Column, *keys: str) -> DataFrame:
    """All due items, before any limit, over all and by each key."""
    return progress.where(is_due(now)).groupingSets([[], *[[k] for k in keys]], *keys).agg(F.count(F.lit(1)).alias("due"))


def funnel(items: DataFrame, progress: DataFrame, *keys: str) -> DataFrame:
    """Items by mastery; those without progress are unseen, fuzzy ones count as learning."""
    m = F.coalesce("mastery", F.lit("unseen"))
    total, done = F.count(F.lit(1)), F.count_if(m == "mastered")
    return items.join(progress, "item_id", "left").groupBy(*keys).agg(
        total.alias("total"), F.count_if(m == "unseen").alias("unseen"), F.count_if(m.isin("learning", "fuzzy")).alias("learning"), F.count_if(m == "reviewing").alias("reviewing"), done.alias("mastered"),
        F.round(done * 100 / F.greatest(total, F.lit(1))).cast("long").alias("percent"),
    )


def schedule(ratings: DataFrame) -> DataFrame:
    """State of each item after its ratings (item_id, ord, at, mastery): mastered ones in a row at the end, and the next review."""
    w = Window.partitionBy("item_id").orderBy("ord")
    broken = F.max(F.when(F.col("mastery") != "mastered", F.col("ord"))).over(w)
    reps = F.count_if(F.col("mastery") == "mastered").over(Window.partitionBy("item_id", "broken").orderBy("ord"))
    last = ratings.withColumn("broken", broken).withColumn("reps", F.when(F.col("mastery") == "mastered", reps).otherwise(0))
    days = F.element_at(F.create_map(*[F.lit(x) for kv in DAYS.items() for x in kv]), F.col("mastery"))
    state = last.groupBy("item_id").agg(F.max_by(F.struct("mastery", "reps", "at"), "ord").alias("s"), F.count(F.lit(1)).alias("ratings")).select("item_id", "s.*", "ratings")
    return state.withColumn("interval_days", F.greatest(F.lit(1), F.coalesce(days, F.lit(1)))).withColumn("next_review", F.date_add(F.to_date("at"), F.col("interval_days")))


def answer_states(answers: DataFrame) -> DataFrame:
    """Per answer (question_id, ord, correct): wrong before, latched, and resolved when right after that. Of answers with one ord the wrong come first, unknown ones last."""
    before = Window.partitionBy("question_id").orderBy(F.asc_nulls_last("ord"), F.asc_nulls_last("correct")).rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.coalesce(F.bool_or(~F.col("correct")).over(before), F.lit(False))
    return answers.withColumn("previously_wrong", wrong).withColumn("resolved", F.col("correct") & wrong)
