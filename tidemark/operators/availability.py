"""What banks of questions have for books and sections: sets of namespaces that overlap, and counts at each level.

A knowledge id has parts between full stops: the first two are its namespace, those up to ch and two digits its
chapter, and one with a part from s on is of a section. Ids are rows, not arrays, so that sets of any size are
compared by equal rows: the pairs of one namespace are made once for each side that has it, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def namespace(knowledge_id: Column) -> Column:
    """The first two parts; empty where there are fewer."""
    return F.regexp_extract(knowledge_id, r"^([^.]*\.[^.]*)", 1)


def chapter(knowledge_id: Column) -> Column:
    """Up to the last part that is ch and two digits; empty where there is none."""
    return F.regexp_extract(knowledge_id, r"^(.+\.ch\d{2})(?:\.|$)", 1)


def _namespaces(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, "domain", namespace(F.col("knowledge_id")).alias("namespace")).where("namespace != ''").distinct()


def namespace_overlap(books: DataFrame, banks: DataFrame) -> DataFrame:
    """(book_id, bank_id) with one domain and a namespace in both. books, banks: (id, domain, knowledge_id), a row for each knowledge id."""
    return _namespaces(books, "book_id").join(_namespaces(banks, "bank_id"), ["domain", "namespace"]).select("book_id", "bank_id").distinct()


def question_counts(questions: DataFrame) -> DataFrame:
    """(bank_id, match_level, knowledge_id, question_count) over questions (bank_id, question_id, knowledge_id), where there are any."""
    k = F.col("knowledge_id")
    levels = F.array(*[F.struct(F.lit(name).alias("match_level"), of.alias("id")) for name, of in (("section", k), ("chapter", chapter(k)), ("comprehensive", namespace(k)))])
    rows = questions.select("bank_id", "question_id", F.inline(levels)).where("id != ''")
    return rows.groupBy("bank_id", "match_level", F.col("id").alias("knowledge_id")).agg(F.count_distinct("question_id").alias("question_count"))


def book_availability(books: DataFrame, banks: DataFrame, counts: DataFrame) -> DataFrame:
    """(book_id, bank_id, knowledge_id, match_level, question_count): for each overlapping bank the namespaces of the book that it has questions of."""
    own = _namespaces(books, "book_id").select("book_id", F.col("namespace").alias("knowledge_id"))
    found = own.join(namespace_overlap(books, banks), "book_id").join(counts.where("match_level = 'comprehensive'"), ["bank_id", "knowledge_id"])
    return found.select("book_id", "bank_id", "knowledge_id", "match_level", "question_count")


def section_availability(sections: DataFrame, books: DataFrame, banks: DataFrame, counts: DataFrame) -> DataFrame:
    """(section_id, bank_id, knowledge_id, match_level, question_count) over sections (section_id, book_id, place, knowledge_id).

    Of an overlapping bank: the longest knowledge id of a section that it has questions of (of equal ones the first), else
    all chapters of the section that it has questions of.
    """
    pairs = sections.join(namespace_overlap(books, banks), "book_id")
    exact = pairs.where(F.contains("knowledge_id", F.lit(".s"))).join(counts.where("match_level = 'section'"), ["bank_id", "knowledge_id"])
    best = exact.groupBy("section_id", "bank_id").agg(F.min(F.struct((-F.length("knowledge_id")).alias("l"), "place", "knowledge_id", "match_level", "question_count")).alias("b"))
    best = best.select("section_id", "bank_id", "b.knowledge_id", "b.match_level", "b.question_count")
    chapters = pairs.select("section_id", "bank_id", chapter(F.col("knowledge_id")).alias("knowledge_id")).where("knowledge_id != ''").distinct()
    chapters = chapters.join(counts.where("match_level = 'chapter'"), ["bank_id", "knowledge_id"]).join(best, ["section_id", "bank_id"], "left_anti")
    return best.unionByName(chapters.select(*best.columns))
