"""Filters, tabs, orders and redacted views of lists. Each is a filter, a conditional count or a window over a key."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVITY_TYPES = ("read", "objective_practice", "subjective_practice", "notebook", "review")


def filtered_activities(df: DataFrame, day: str | None = None, kind: str | None = None) -> DataFrame:
    """Activities of a day, a kind or both; a day that is no ISO date or an unknown kind is an error. Keys of ingest are left out."""
    if day is not None:
        df = df.where(F.col("date") == F.lit(datetime.date.fromisoformat(day)))
    if kind is not None:
        if kind not in ACTIVITY_TYPES:
            raise ValueError(f"unknown activity type: {kind}")
        df = df.where(F.col("activity_type") == kind)
    return df.drop("idempotency_keys")


def redacted(df: DataFrame, hidden: tuple[str, ...], revealed: Column) -> DataFrame:
    """df whose hidden columns are null where revealed does not hold."""
    return df.withColumns({c: F.when(revealed, F.col(c)) for c in hidden})


def band(number: Column) -> Column:
    """A question's part of a paper, by its number."""
    return F.when(number <= 20, "cloze").when(number <= 40, "reading").otherwise("writing")


def tab_counts(df: DataFrame, by: str, **tabs: Column) -> DataFrame:
    """Rows of each tab, in one pass."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in tabs.items()])


def newest_resolved_first(df: DataFrame, by: str, resolved: Column, answered: str, tie: str) -> DataFrame:
    """df with place: resolved rows first, newer ones first, and of equal ones the earlier arrival."""
    order = Window.partitionBy(by).orderBy(resolved.cast("int").desc(), F.desc(answered), F.asc(tie))
    return df.withColumn("place", F.row_number().over(order))


def chapters_with_items(df: DataFrame, kinds: Column, completed: Column) -> DataFrame:
    """Chapters with items of the asked kind: how many, starred and completed ones, and the per cent completed; empty chapters go."""
    out = df.where(kinds).groupBy("chapter_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("star_level") > 0).alias("starred"), F.count_if(completed).alias("completed"))
    return out.where("items > 0").withColumn("percent", F.floor(F.col("completed") * 100 / F.col("items") + 0.5).cast("long"))


def has_recall(answer: Column, note: Column, mastery: Column) -> Column:
    """An item counts as worked on with an answer, a note or a mastery other than unseen."""
    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return filled(answer) | filled(note) | F.coalesce(mastery != "unseen", F.lit(False))


def file_order(name: Column) -> Column:
    """Sort key of a chapter's file: its leading number, files without one last, then its name."""
    number = F.regexp_extract(name, r"^\s*(\d+)", 1)
    return F.struct((number == "").alias("last"), F.when(number != "", number.cast("long")).alias("number"), name.alias("name"))


def heading_candidates(df: DataFrame, key: str, text: str, most: int = 20, longest: int = 60) -> DataFrame:
    """(key, line, title): the first lines of each text that could be headings, most at most, as the list is."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line", "title")).where((F.length(F.trim("title")) > 0) & (F.length("title") <= longest))
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("line"))).where(F.col("nth") <= most).drop("nth")


def domain_before_fallback(attempts: DataFrame, banks: DataFrame, domain: str) -> DataFrame:
    """Attempts of a domain by the bank that they name; only then do those of an unknown bank move to one that has the question.

    attempts (question_id, bank_id, domain), banks (bank_id, question_id). The domain is not looked at again after the move.
    """
    asked = attempts.where(F.col("domain") == domain)
    any_bank = banks.groupBy("question_id").agg(F.min("bank_id").alias("any_bank"))
    named = banks.select("bank_id", "question_id", F.lit(True).alias("named")).distinct()
    out = asked.join(named, ["bank_id", "question_id"], "left").join(any_bank, "question_id", "left")
    return out.select("question_id", F.when(F.col("named"), F.col("bank_id")).otherwise(F.col("any_bank")).alias("bank_id")).where("bank_id is not null")


def histograms(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n) of each column, in one pass over one stacked row set."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
