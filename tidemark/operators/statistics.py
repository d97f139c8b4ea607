"""The statistics page: facts of all kinds by day, by book and by subject, each from one pass over its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Whole per cent, half up; 0 of nothing."""
    return F.when(whole > 0, F.floor(part * 100 / whole + 0.5)).otherwise(0).cast("long")


def day_facts(days: DataFrame, activities: DataFrame, notes: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row for each day that any source knows: the sources are stacked and summed once, which spares outer joins.

    days (date, reading_seconds), activities (date, duration_seconds), notes (date, markdown), reviews (date).
    """
    zero = {c: F.lit(0).cast("long") for c in ("legacy_seconds", "unified_seconds", "activities", "notes", "note_chars", "reviews")}
    row = lambda df, **own: df.select("date", *[own.get(c, zero[c]).cast("long").alias(c) for c in zero])
    one, written = F.lit(1), F.trim("markdown") != ""
    stacked = row(days, legacy_seconds=F.col("reading_seconds")).unionByName(row(activities, unified_seconds=F.col("duration_seconds"), activities=one))
    stacked = stacked.unionByName(row(notes.where(written), notes=one, note_chars=F.length("markdown"))).unionByName(row(reviews, reviews=one))
    out = stacked.groupBy("date").agg(*[F.sum(c).alias(c) for c in zero])
    residual = F.greatest(F.lit(0), F.col("legacy_seconds") - F.col("unified_seconds"))
    active = (F.col("activities") > 0) | (F.col("legacy_seconds") > 0) | (F.col("notes") > 0) | (F.col("reviews") > 0)
    return out.withColumns({"effective_seconds": F.greatest("legacy_seconds", "unified_seconds"), "residual_seconds": residual, "active": active})


def totals(facts: DataFrame) -> DataFrame:
    """One row of sums over day_facts()."""
    names = ("legacy_seconds", "unified_seconds", "residual_seconds", "notes", "note_chars")
    return facts.agg(F.count_if("active").alias("active_days"), *[F.sum(c).alias(c) for c in names])


def notes_per_book(sections: DataFrame, notes: DataFrame) -> DataFrame:
    """Books without notes stay, with 0. notes (section_id, markdown)."""
    own = notes.where(F.trim("markdown") != "").groupBy("section_id").agg(F.count(F.lit(1)).alias("n"))
    return sections.join(own, "section_id", "left").groupBy("book_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("notes"), F.count(F.lit(1)).alias("sections"))


def book_summary(sections: DataFrame, activities: DataFrame, noted: DataFrame) -> DataFrame:
    """Per book: seconds, sections opened or noted, their share, and the last day and section (of one day the later arrival).

    activities (section_id, date, ord, duration_seconds); noted (section_id). Both are summed by section before they meet books.
    """
    opened = activities.groupBy("section_id").agg(F.sum("duration_seconds").alias("seconds"), F.max(F.struct("date", "ord")).alias("last"))
    noted = noted.select("section_id", F.lit(True).alias("noted")).distinct()
    known = sections.select("section_id", "book_id").join(opened, "section_id", "left").join(noted, "section_id", "left")
    learned = F.count_if(F.col("last").isNotNull() | F.coalesce("noted", F.lit(False)))
    last = F.max(F.when(F.col("last").isNotNull(), F.struct("last.date", "last.ord", "section_id")))
    out = known.groupBy("book_id").agg(F.coalesce(F.sum("seconds"), F.lit(0)).alias("seconds"), learned.alias("learned"), F.count(F.lit(1)).alias("sections"), last.alias("at"))
    return out.select("book_id", "seconds", "learned", "sections", percent(F.col("learned"), F.col("sections")).alias("coverage"), F.col("at.date").alias("last_day"), F.col("at.section_id").alias("last_section"))


def practice_summary(attempts: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row: answered, correct, accuracy, and the non-blank analyses with their characters."""
    right = attempts.agg(F.count("correct").alias("answered"), F.count_if("correct").alias("right"))
    own = analyses.where(F.trim("content") != "").agg(F.count(F.lit(1)).alias("analyses"), F.coalesce(F.sum(F.length(F.trim("content"))), F.lit(0)).alias("analysis_chars"))
    return right.crossJoin(own).withColumn("accuracy", percent(F.col("right"), F.col("answered")))  # two rows of one


def subject_tiles(sections: DataFrame, noted: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per domain: books, sections, sections with notes and their share, answers and their accuracy. attempts (section_id, correct)."""
    noted = noted.select("section_id", F.lit(1).alias("noted")).distinct()
    answers = attempts.groupBy("section_id").agg(F.count("correct").alias("answers"), F.count_if("correct").alias("right"))
    rows = sections.join(noted, "section_id", "left").join(answers, "section_id", "left")
    none = F.lit(0)
    out = rows.groupBy("domain").agg(
        F.count_distinct("book_id").alias("books"), F.count(F.lit(1)).alias("sections"), F.coalesce(F.sum("noted"), none).alias("notes"),
        F.coalesce(F.sum("answers"), none).alias("answers"), F.coalesce(F.sum("right"), none).alias("right"),
    )
    return out.withColumns({"coverage": percent(F.col("notes"), F.col("sections")), "accuracy": percent(F.col("right"), F.col("answers"))})


def today(activities: DataFrame, as_of: DataFrame, most: int = 8) -> DataFrame:
    """One row: whole minutes and activities of the day, and its last activities in order of arrival. as_of has one row."""
    rows = activities.join(F.broadcast(as_of), activities["date"] == as_of["as_of"])
    top = rows.orderBy(F.desc("ord")).limit(most).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "activity_id"))), lambda x: x["activity_id"]).alias("last"))
    sums = rows.agg(F.floor(F.coalesce(F.sum("duration_seconds"), F.lit(0)) / 60).cast("long").alias("minutes"), F.count(F.lit(1)).alias("activities"))
    return sums.crossJoin(top)


def log_days(archived: DataFrame, learned: DataFrame, most_chars: int = 100) -> DataFrame:
    """Archived and learned days together; an archived text goes before one derived from the day, and its preview is cut at most_chars.

    archived (date, content), learned (date, content).
    """
    stacked = archived.select("date", "content", F.lit(0).alias("rank")).unionByName(learned.select("date", "content", F.lit(1).alias("rank")))
    best = stacked.groupBy("date").agg(F.min("rank").alias("rank"), F.min_by("content", F.when(F.trim("content") != "", F.col("rank"))).alias("content"))
    content = F.coalesce("content", F.lit(""))
    return best.select("date", (F.col("rank") == 1).alias("only_activity"), F.when(F.length(content) > most_chars, F.concat(F.substring(content, 1, most_chars), F.lit("…"))).otherwise(content).alias("preview"))


def seen_items(*sources: DataFrame) -> DataFrame:
    """Distinct (kind, item) of all sources."""
    out = sources[0].select("kind", "item")
    for s in sources[1:]:
        out = out.unionByName(s.select("kind", "item"))
    return out.where("item is not null").distinct()
