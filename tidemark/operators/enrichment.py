"""Records with what other tables know of them: where an activity goes on, notes with their questions, due items with their subjects.

All are equi-joins; ids that a table has twice should be made one beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_blank

LEVELS = ("section", "chapter", "comprehensive")


def match_places(questions: DataFrame) -> DataFrame:
    """(bank_id, knowledge_id, level, question_id, place): the place from 0 of each question among those that match an id at a level.

    questions: (bank_id, question_id, ord, scope, knowledge_ids). Level comprehensive asks for questions of that scope; the
    two others match alike, and have one row, level null. Of a question twice in a bank the first place counts.
    """
    each = questions.select("bank_id", "question_id", "ord", "scope", F.explode(F.array_distinct("knowledge_ids")).alias("knowledge_id"))
    both = each.withColumn("level", F.explode(F.when(F.col("scope") == "comprehensive", F.array(F.lit(None).cast("string"), F.lit("comprehensive"))).otherwise(F.array(F.lit(None).cast("string")))))
    order = Window.partitionBy("bank_id", "knowledge_id", "level").orderBy("ord", "question_id")
    return both.withColumn("place", F.row_number().over(order) - 1).groupBy("bank_id", "knowledge_id", "level", "question_id").agg(F.min("place").alias("place"))


def resume_places(targets: DataFrame, questions: DataFrame) -> DataFrame:
    """targets with question_number, knowledge_id, match_level and start_index.

    targets: (bank_id, question_id, knowledge_id, match_level, ...), the last two null where unknown: then the last id of the
    question, and section for a question of several ids, comprehensive otherwise. What is not found starts at 0; a question
    that its bank lacks, or without ids, keeps its target as it is, start_index null.
    questions: (bank_id, question_id, ord, number, scope, knowledge_ids), each question once a bank.
    """
    known = questions.select("bank_id", "question_id", F.col("number").alias("question_number"), "knowledge_ids")
    rows = targets.join(known, ["bank_id", "question_id"], "left")
    has = F.coalesce(F.size("knowledge_ids") > 0, F.lit(False))
    usual = F.when(F.size("knowledge_ids") > 1, "section").otherwise("comprehensive")
    rows = rows.withColumn("match_level", F.when(has, F.when(F.col("match_level").isin(*LEVELS), F.col("match_level")).otherwise(usual)).otherwise(F.col("match_level")))
    rows = rows.withColumn("knowledge_id", F.when(has, F.coalesce("knowledge_id", F.element_at(F.when(has, F.col("knowledge_ids")), -1))).otherwise(F.col("knowledge_id"))).withColumn("has", has).drop("knowledge_ids")
    places = match_places(questions).select("bank_id", "question_id", "knowledge_id", F.col("level").alias("asked"), "place")
    asked = F.when(F.col("match_level") == "comprehensive", "comprehensive")
    found = rows.withColumn("asked", asked).alias("t").join(places.alias("p"), F.expr("t.bank_id = p.bank_id AND t.question_id = p.question_id AND t.knowledge_id = p.knowledge_id AND t.asked <=> p.asked"), "left")
    return found.select("t.*", F.when(F.col("has"), F.coalesce("p.place", F.lit(0))).alias("start_index")).drop("asked", "has")


def home_summary(activities: DataFrame, sections: DataFrame, books: DataFrame, banks: DataFrame) -> DataFrame:
    """activities with title, resource_id, resource_title, domain and subject for a page of recent work.

    activities: (activity_id, activity_type, item_id, resource_id, domain, subject_id, question_number, ...);
    sections: (section_id, title, book_id); books: (book_id, title, domain, subject); banks: (bank_id, title).
    A blank value gives way to that of the book, an unknown title to the id.
    """
    s = sections.select(F.col("section_id").alias("item_id"), F.nullif("title", F.lit("")).alias("section_title"), "book_id")
    b = books.select("book_id", F.nullif("title", F.lit("")).alias("book_title"), F.col("domain").alias("book_domain"), F.col("subject").alias("book_subject"))
    rows = activities.join(s, "item_id", "left").join(b, "book_id", "left")
    kind, item, given = F.col("activity_type"), F.coalesce("item_id", F.lit("")), F.coalesce("resource_id", F.lit(""))
    own = F.nullif("subject_id", F.lit(""))
    rows = rows.withColumn("resource", F.when(F.col("book_domain").isNotNull() | F.col("book_title").isNotNull(), F.col("book_id")).otherwise(given))
    rows = rows.join(banks.select(F.col("bank_id").alias("resource"), F.nullif("title", F.lit("")).alias("bank_title")), "resource", "left")
    title = (
        F.when(kind.isin("read", "subjective_practice"), F.coalesce("section_title", item))
        .when((kind == "objective_practice") & F.col("question_number").isNotNull(), F.concat(F.lit("第 "), "question_number", F.lit(" 题"))).when(kind == "objective_practice", F.concat(F.lit("题目 "), item))
        .when(kind == "notebook", F.concat(item, F.lit(" · 英语周记"))).when(kind == "review", F.concat(item, F.lit(" · 学习回顾"))).otherwise(item)
    )
    usual = F.coalesce("book_title", "resource")
    resource_title = F.when(kind == "objective_practice", F.coalesce("bank_title", usual)).when(kind == "notebook", F.lit("英语周记")).when(kind == "review", F.coalesce(own, usual)).otherwise(usual)
    return rows.select(
        "activity_id", "activity_type", item.alias("item_id"), title.alias("title"), F.col("resource").alias("resource_id"), resource_title.alias("resource_title"),
        F.coalesce(F.nullif("domain", F.lit("")), "book_domain", F.lit("")).alias("domain"), F.coalesce(own, "book_subject", F.lit("")).alias("subject_id"),
    )


def noted_questions(questions: DataFrame, analyses: DataFrame, attempts: DataFrame) -> DataFrame:
    """questions that have an analysis of their own that is not blank, with it and with the attempt, if any. All by question_id."""
    return questions.join(analyses.where(~is_blank(F.col("content"))), "question_id").join(attempts, "question_id", "left")


def known_due(due: DataFrame, items: DataFrame) -> DataFrame:
    """Due rows (item_id, ...) whose item is known, with its type and subject; a blank subject is other."""
    return due.join(items.select("item_id", "type", F.coalesce(F.nullif("subject_id", F.lit("")), F.lit("other")).alias("subject_id")), "item_id")


def due_by_subject(due: DataFrame) -> DataFrame:
    """Per subject: due items, definitions and others."""
    n, d = F.count(F.lit(1)), F.count_if(F.col("type").eqNullSafe("definition"))
    return due.groupBy("subject_id").agg(n.alias("due"), d.alias("definitions"), (n - d).alias("essays"))


def with_notes(items: DataFrame, progress: DataFrame) -> DataFrame:
    """items with memory_note, trimmed, empty where there is none, and has_note."""
    note = F.coalesce(F.regexp_replace("memory_note", r"(?U)^\s+|\s+$", ""), F.lit(""))
    return items.join(progress.select("item_id", "memory_note"), "item_id", "left").withColumn("memory_note", note).withColumn("has_note", F.col("memory_note") != "")
