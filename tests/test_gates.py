"""Gates of a publication on small fixtures with nulls, twins and what is missing."""

from tidemark.operators import gates as G


def rows(df):
    return sorted((r["book_id"], r["code"], r["place"]) for r in df.collect())


def test_outline_against_its_source(spark):
    outlines = spark.createDataFrame([("a", "h", 3, 1, 3, "T", "2"), ("b", "x", None, 2, 1, "", None), ("gone", None, 0, None, 1, None, "e")], "book_id string, sha256 string, line_count int, start_line int, end_line int, title string, edition string")
    sources = spark.createDataFrame([("a", "h", 3), ("b", "y", 2)], "book_id string, actual_sha256 string, n_lines int")
    assert rows(G.source_gates(outlines, sources)) == [("b", "content_range", ""), ("b", "source_hash", ""), ("b", "source_line_count", ""), ("gone", "content_range", "")]
    lines = spark.createDataFrame([("a", 1, "The T."), ("a", 2, "2nd"), ("a", 3, "aaa aaa"), ("b", 1, ""), ("b", 2, None)], "book_id string, line int, text string")
    evidence = spark.createDataFrame([("a", 0, "title", 1, "T."), ("a", 1, "edition", 1, "2nd"), ("a", 2, "isbn", 1, "T"), ("a", 3, "title", None, "T"), ("a", 4, "title", 9, "T"), ("a", 5, "title", 2, ""), ("b", 0, "title", 2, "q")], "book_id string, n int, field string, line int, quote string")
    assert rows(G.evidence_gates(outlines, evidence, lines)) == [
        ("a", "identity_evidence_missing", "1"), ("a", "identity_evidence_missing", "4"), ("a", "identity_evidence_required", "edition"), ("a", "identity_evidence_shape", "2"), ("a", "identity_evidence_shape", "3"), ("a", "identity_evidence_shape", "5"),
        ("b", "identity_evidence_missing", "0"), ("gone", "identity_evidence_required", "edition"),
    ]
    changes = [("a", 0, 3, "aa", "b", "r", 2), ("a", 1, 3, "aa", "c", "r", None), ("a", 2, 3, "aaa", "b", "r", None), ("a", 3, 9, "zz", "b", "r", None), ("a", 4, 3, "a", "b", "r", 6), ("a", 5, 3, "aa", "b", "　", 2), ("a", 6, 1, "TT", "TT", "r", 1), ("a", 7, 1, "Th", None, "r", 1), ("a", 8, None, "Th", "t", "r", 1), ("a", 9, 1, "Th", "t", "r", 0), ("b", 0, 1, "xx", "y", "r", 1)]
    got = rows(G.replacement_gates(outlines, spark.createDataFrame(changes, "book_id string, n int, line int, old string, new string, reason string, count int"), lines))
    assert got == sorted([("a", "replacement_duplicate", "1"), ("a", "replacement_evidence", "2"), ("a", "replacement_line", "3"), *[("a", "replacement_shape", str(i)) for i in range(4, 10)], ("b", "replacement_line", "0")])


def test_chapters(spark):
    schema = "book_id string, ord int, chapter_id string, artifact string, character_count int"
    chapters = [("a", 0, "p", "x/00-preface.md", 500), ("a", 1, "c1", "x/01-one.md", 200), ("a", 2, "c2", "02-two.md", 199), ("b", 0, "c1", "01-a.md", 900), ("b", 1, "c3", "03-a.md", None), ("c", 0, "c2", "2-a.md", 900), ("c", 1, "c1", "1-a.md", 900), ("d", 0, "n", "none.md", 900), ("d", 1, "n2", None, 900)]
    lengths = spark.createDataFrame([("a", 100, 85, 73), ("b", 100, 84, 84), ("c", 0, 0, 0), ("d", 10, None, 9)], "book_id string, original long, candidate long, published long")
    got = rows(G.chapter_gates(spark.createDataFrame(chapters, schema), lengths))
    short, both = "candidate_abnormally_short", "published_chapters_abnormally_short"
    assert got == sorted([("a", "empty_or_too_short_chapter", "c2"), ("b", "chapter_order_gap_or_duplicate", ""), ("b", "empty_or_too_short_chapter", "c3"), ("b", short, ""), ("c", "chapter_order_gap_or_duplicate", ""), ("c", short, ""), ("c", both, ""), ("d", short, ""), ("d", both, "")])
    assert G.chapter_gates(spark.createDataFrame([], schema), lengths.limit(0)).count() == 0
