"""Joins that add to records, on small fixtures with nulls, blanks, orphans and twins."""

from tidemark.operators import enrichment as E

QUESTIONS = "bank_id string, question_id string, ord int, number int, scope string, knowledge_ids array<string>"
TARGETS = "bank_id string, question_id string, knowledge_id string, match_level string"


def questions(spark):
    rows = [("b", "q1", 0, 11, "chapter", ["x", "y"]), ("b", "q2", 1, 12, "comprehensive", ["x"]), ("b", "q3", 2, None, "comprehensive", ["x", "x", "y"]), ("b", "q4", 3, 14, "chapter", []), ("b", "q5", 4, 15, "chapter", None), ("c", "q3", 0, 1, "chapter", ["y"])]
    return spark.createDataFrame(rows, QUESTIONS)


def test_resume_places(spark):
    targets = [("b", "q3", None, None), ("b", "q3", "x", "comprehensive"), ("b", "q3", "x", "odd"), ("b", "q2", None, None), ("b", "q1", "x", "comprehensive"), ("b", "q4", "x", "chapter"), ("b", "q5", None, None), ("c", "q9", None, "section"), (None, None, None, None), ("c", "q3", None, None)]
    got = E.resume_places(spark.createDataFrame(targets, TARGETS), questions(spark)).select("bank_id", "question_id", "knowledge_id", "match_level", "question_number", "start_index")
    want = [("b", "q3", "y", "section", None, 1), ("b", "q3", "x", "comprehensive", None, 1), ("b", "q3", "x", "section", None, 2), ("b", "q2", "x", "comprehensive", 12, 0), ("b", "q1", "x", "comprehensive", 11, 0), ("b", "q4", "x", "chapter", 14, None), ("b", "q5", None, None, 15, None), ("c", "q9", None, "section", None, None), (None, None, None, None, None, None), ("c", "q3", "y", "comprehensive", 1, 0)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert E.resume_places(spark.createDataFrame([], TARGETS), questions(spark)).count() == 0


def test_home_summary(spark):
    a = spark.createDataFrame(
        [("1", "read", "s1", "r", "", None, None), ("2", "read", "s9", "r", "d", "u", None), ("3", "objective_practice", "q", "b1", None, None, 7), ("4", "objective_practice", "q", "b9", None, None, None), ("5", "notebook", "w", None, None, None, None), ("6", "review", "d", "r", None, "med", None), ("7", "subjective_practice", "s2", "r", None, None, None), ("8", None, None, None, None, None, None)],
        "activity_id string, activity_type string, item_id string, resource_id string, domain string, subject_id string, question_number int",
    )
    s = spark.createDataFrame([("s1", "One", "k"), ("s2", "", "gone")], "section_id string, title string, book_id string")
    books = spark.createDataFrame([("k", "Book", "bd", "bs")], "book_id string, title string, domain string, subject string")
    banks = spark.createDataFrame([("b1", "Bank")], "bank_id string, title string")
    got = {r["activity_id"]: tuple(r)[3:] for r in E.home_summary(a, s, books, banks).collect()}
    assert got == {
        "1": ("One", "k", "Book", "bd", "bs"), "2": ("s9", "r", "r", "d", "u"), "3": ("第 7 题", "b1", "Bank", "", ""), "4": ("题目 q", "b9", "b9", "", ""), "5": ("w · 英语周记", "", "英语周记", "", ""),
        "6": ("d · 学习回顾", "r", "med", "", "med"), "7": ("s2", "r", "r", "", ""), "8": ("", "", "", "", ""),
    }


def test_notes_and_due(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "question_id string")
    notes = spark.createDataFrame([("a", "x"), ("b", "　\n"), ("c", None), ("d", "y"), ("z", "w")], "question_id string, content string")
    tries = spark.createDataFrame([("a", True), ("z", False)], "question_id string, correct boolean")
    assert sorted(tuple(r) for r in E.noted_questions(q, notes, tries).collect()) == [("a", "x", True), ("d", "y", None)]
    items = spark.createDataFrame([("a", "definition", "m"), ("b", None, ""), ("c", "essay", None)], "item_id string, type string, subject_id string")
    due = E.known_due(spark.createDataFrame([("a",), ("b",), ("c",), ("orphan",), (None,)], "item_id string"), items)
    assert sorted(tuple(r) for r in E.due_by_subject(due).collect()) == [("m", 1, 1, 0), ("other", 2, 0, 2)]
    noted = E.with_notes(items, spark.createDataFrame([("a", "　hi there \n"), ("b", " "), ("z", "q")], "item_id string, memory_note string"))
    assert sorted((r["item_id"], r["memory_note"], r["has_note"]) for r in noted.collect()) == [("a", "hi there", True), ("b", "", False), ("c", "", False)]
