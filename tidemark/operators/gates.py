"""Gates before a book is published: its outline against the lines of its source, and its chapters against their numbers and lengths.

Findings are (book_id, code, place). Lines are rows, so that what an outline cites of them is a join; a book of any length is no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import is_blank

# Fields that need evidence, and the least lengths.
EVIDENT = ("title", "edition")
LEAST_CHAPTER, LEAST_OLD, LEAST_RATIO = 200, 2, 0.85


def _found(rows: DataFrame, place: Column, *rules: tuple[str, Column]) -> DataFrame:
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules]), lambda x: x.isNotNull())
    return rows.select("book_id", F.explode(codes).alias("code"), place.cast("string").alias("place"))


def source_gates(outlines: DataFrame, sources: DataFrame) -> DataFrame:
    """Hash, number of lines and range of the content. outlines: (book_id, sha256, line_count, start_line, end_line); sources: (book_id, actual_sha256, n_lines)."""
    rows = outlines.join(sources, "book_id", "left").na.fill(0, ["n_lines"])
    start, end = F.col("start_line"), F.col("end_line")
    inside = F.coalesce((start >= 1) & (end >= start) & (end <= F.col("n_lines")), F.lit(False))
    return _found(
        rows, F.lit(""), ("source_hash", ~F.col("sha256").eqNullSafe(F.col("actual_sha256"))), ("source_line_count", ~F.col("line_count").eqNullSafe(F.col("n_lines"))), ("content_range", ~inside)
    )


def evidence_gates(outlines: DataFrame, evidence: DataFrame, lines: DataFrame) -> DataFrame:
    """Title and edition, where given, must be quoted from the line they cite.

    outlines: (book_id, title, edition); evidence: (book_id, n, field, line, quote); lines: (book_id, line, text), each line once.
    """
    shaped = F.coalesce(F.col("field").isin(*EVIDENT) & F.col("line").isNotNull() & (F.col("quote") != ""), F.lit(False))
    rows = evidence.withColumn("shaped", shaped).join(lines, ["book_id", "line"], "left")
    rows = rows.withColumn("there", F.col("shaped") & F.coalesce(F.contains("text", "quote"), F.lit(False)))
    needed = outlines.select("book_id", F.explode(F.array(*[F.when(F.coalesce(F.col(f) != "", F.lit(False)), F.lit(f)) for f in EVIDENT])).alias("field")).where("field IS NOT NULL")
    lacking = needed.join(rows.where("there").select("book_id", "field").distinct(), ["book_id", "field"], "left_anti")
    return _found(rows, F.col("n"), ("identity_evidence_shape", ~F.col("shaped")), ("identity_evidence_missing", F.col("shaped") & ~F.col("there"))).unionByName(
        lacking.select("book_id", F.lit("identity_evidence_required").alias("code"), F.col("field").alias("place"))
    )


def replacement_gates(outlines: DataFrame, replacements: DataFrame, lines: DataFrame) -> DataFrame:
    """Replacements (book_id, n, line, old, new, reason, count) must be well formed, once a line and text, within the content, and occur as often as said.

    A null count is one. Of equal ones the first by n counts; malformed ones are not compared. A line that the source lacks has no occurrence.
    """
    count = F.coalesce("count", F.lit(1))
    shaped = F.coalesce(F.col("line").isNotNull() & (F.length("old") >= LEAST_OLD) & (F.col("old") != F.col("new")) & ~is_blank(F.col("reason")) & (count >= 1), F.lit(False))
    rows = replacements.withColumn("count", count).withColumn("shaped", shaped)
    first = F.row_number().over(Window.partitionBy("book_id", "line", "old").orderBy("n"))
    good = rows.where("shaped").withColumn("twin", first)
    cited = good.where("twin = 1").join(outlines.select("book_id", "start_line", "end_line"), "book_id", "left").join(lines, ["book_id", "line"], "left")
    inside = F.coalesce(F.col("line").between(F.col("start_line"), F.col("end_line")), F.lit(False))
    text = F.coalesce("text", F.lit(""))
    times = ((F.length(text) - F.length(F.replace(text, F.col("old"), F.lit("")))) / F.length("old")).cast("long")
    return (
        _found(rows, F.col("n"), ("replacement_shape", ~F.col("shaped"))).unionByName(_found(good, F.col("n"), ("replacement_duplicate", F.col("twin") > 1)))
        .unionByName(_found(cited, F.col("n"), ("replacement_line", ~inside), ("replacement_evidence", inside & (times != F.col("count")))))
    )


def chapter_gates(chapters: DataFrame, lengths: DataFrame) -> DataFrame:
    """Short chapters, numbers of files that are not 1, 2, 3 in order, and texts that shrank.

    chapters: (book_id, ord, chapter_id, artifact, character_count); lengths: (book_id, original, candidate, published).
    """
    short = _found(chapters, F.col("chapter_id"), ("empty_or_too_short_chapter", F.coalesce("character_count", F.lit(0)) < LEAST_CHAPTER))
    name = F.element_at(F.split("artifact", "/"), -1)
    numbered = chapters.withColumn("number", F.nullif(F.regexp_extract(name, r"^(\d+)-", 1), F.lit("")).try_cast("long")).where("number > 0")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    gaps = numbered.withColumn("place", place).where("number <> place").select("book_id").distinct().select("book_id", F.lit("chapter_order_gap_or_duplicate").alias("code"), F.lit("").alias("place"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0)
    shrunk = _found(lengths.na.fill(0), F.lit(""), ("candidate_abnormally_short", ratio("candidate", "original") < LEAST_RATIO), ("published_chapters_abnormally_short", ratio("published", "candidate") < LEAST_RATIO))
    return short.unionByName(gaps).unionByName(shrunk)
