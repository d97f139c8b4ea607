"""Question practice: sessions, availability, mistakes, runs, and effort over books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_mistake() -> Column:
    """A wrong answer, or one that was wrong before; a null answer is none."""
    return F.coalesce(~F.col("correct"), F.lit(False)) | F.coalesce("previously_wrong", F.lit(False))


def is_resolved() -> Column:
    return F.coalesce("correct", F.lit(False)) & F.coalesce("previously_wrong", F.lit(False))


def session_progress(questions: DataFrame, attempts: DataFrame, bank: str) -> DataFrame:
    """Per bank: questions, those answered, and those answered right."""
    rows = questions.join(attempts, "question_id", "left")
    return rows.groupBy(bank).agg(F.count(F.lit(1)).alias("total"), F.count("correct").alias("answered"), F.count_if("correct").alias("right"))


def availability(questions: DataFrame, *keys: str) -> DataFrame:
    """Questions for each combination of keys that has any."""
    return questions.groupBy(*keys).agg(F.count_distinct("question_id").alias("questions")).where("questions > 0")


def most_specific(sections: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions of each section by its longest matching knowledge id, else by its chapter.

    sections: (section_id, knowledge_ids, chapter_id); questions: (question_id, knowledge_id).
    """
    own = sections.select("section_id", F.explode("knowledge_ids").alias("knowledge_id")).withColumn("level", F.lit(0))
    chapter = sections.select("section_id", F.col("chapter_id").alias("knowledge_id"), F.lit(1).alias("level"))
    asked = questions.groupBy("knowledge_id").agg(F.count_distinct("question_id").alias("questions"))  # counted first: a section meets each id once, not each question
    hits = own.unionByName(chapter).join(asked, "knowledge_id")
    best = F.min(F.struct("level", (-F.length("knowledge_id")).alias("size"), "knowledge_id", "questions")).alias("best")
    return hits.groupBy("section_id").agg(best).select("section_id", "best.knowledge_id", "best.questions", "best.level")


def in_any_bank(attempts: DataFrame, questions: DataFrame) -> DataFrame:
    """Attempts with their question: of the named bank, else of the first bank in bank_order that has it.

    attempts: (question_id, bank_id, ...); questions: (question_id, bank_id, bank_order, ...).
    """
    q = questions.withColumnRenamed("bank_id", "found_bank")
    best = Window.partitionBy("question_id", "bank_id").orderBy(F.when(F.col("found_bank") == F.col("bank_id"), 0).otherwise(1), "bank_order", "found_bank")
    return attempts.join(q, "question_id").withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def mistake_totals(attempts: DataFrame, *keys: str) -> DataFrame:
    rows = attempts.where(is_mistake()).withColumn("resolved", is_resolved())
    total, done = F.count(F.lit(1)), F.count_if("resolved")
    return rows.groupBy(*keys).agg(total.alias("mistakes"), (total - done).alias("pending"), done.alias("resolved"), F.round(done * 100 / F.greatest(total, F.lit(1))).cast("long").alias("resolve_percent"))


def mistake_ordinals(attempts: DataFrame, group: str) -> DataFrame:
    """Place of each mistake in its group: resolved ones first, newest (largest question_id) first."""
    order = Window.partitionBy(group).orderBy(F.desc("resolved"), F.desc("question_id"))
    return attempts.where(is_mistake()).withColumn("resolved", is_resolved()).select(group, "question_id", "resolved", F.row_number().over(order).alias("ordinal"))


def runs(rows: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Runs of equal consecutive keys; a key that comes back begins a new run."""
    w = Window.partitionBy(group).orderBy(order)
    new = F.coalesce(~F.col(key).eqNullSafe(F.lag(key).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    marked = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(group, "run").agg(F.first(key).alias(key), F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"), F.max(F.length("text")).alias("longest"))


def book_progress(sections: DataFrame, learned: DataFrame) -> DataFrame:
    """Sections of each book, distinct learned ones, and percent; books without any stay. learned: (section_id)."""
    rows = sections.join(learned.select("section_id").distinct().withColumn("seen", F.lit(True)), "section_id", "left")
    total, seen = F.count_distinct("section_id"), F.count_distinct(F.when(F.col("seen"), F.col("section_id")))
    return rows.groupBy("book_id").agg(total.alias("sections"), seen.alias("learned"), F.round(seen * 100 / F.greatest(total, F.lit(1)), 1).alias("percent"))


def effort_by_domain(sections: DataFrame, timed: DataFrame) -> DataFrame:
    """Seconds, distinct sections and characters of each domain. timed: (section_id, seconds)."""
    rows = timed.groupBy("section_id").agg(F.sum("seconds").alias("seconds")).join(sections, "section_id")
    return rows.groupBy("domain").agg(F.sum("seconds").alias("seconds"), F.count_distinct("section_id").alias("sections"), F.sum("character_count").alias("characters"))


def page_sizes(sections: DataFrame, most: int) -> DataFrame:
    n = F.col("character_count")
    return sections.groupBy("book_id").agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.sum(n) / F.count(n)).cast("long").alias("mean"), F.sum(n).alias("total"), F.count_if(n > most).alias("oversized"))
