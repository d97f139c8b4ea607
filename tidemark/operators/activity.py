"""Activity facts: coalescing, what counts as meaningful, totals, and what to go on with.

Every operator is a function of DataFrames. Seconds are never negative, the day that a
query looks from is a parameter, and ties fall to the earliest arrival (ord).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEANINGFUL_SECONDS = 60
TYPES = ("read", "objective_practice", "subjective_practice", "review", "notebook")
DOMAINS = ("medicine", "politics", "english")
SLOTS = ("morning", "afternoon", "evening")


def seconds(column: str = "duration_seconds") -> Column:
    return F.greatest(F.lit(0), F.coalesce(F.col(column), F.lit(0))).cast("long")


def _done(state: str = "result_state", refs: str = "output_refs") -> Column:
    return F.coalesce(F.col(state).isin("has_output", "completed"), F.lit(False)) | (F.size(F.coalesce(refs, F.array().cast("array<string>"))) > 0)


def is_meaningful(include_review: bool = True) -> Column:
    """A minute or more, an output or a completed state; reviews count unless left out."""
    out = (seconds() >= MEANINGFUL_SECONDS) | _done()
    return out if include_review else out & (F.col("activity_type") != "review")


def is_completed_review() -> Column:
    return (F.col("activity_type") == "review") & _done()


def bucket(domain: str = "domain") -> Column:
    """Totals put unknown domains in a bucket of their own; safe_domain does not."""
    return F.when(F.lower(F.trim(domain)).isin(*DOMAINS), F.lower(F.trim(domain))).otherwise("other")


def safe_domain(domain: str = "domain") -> Column:
    return F.when(F.lower(F.trim(domain)).isin(*DOMAINS), F.lower(F.trim(domain))).otherwise("medicine")


def coalesced(activities: DataFrame) -> DataFrame:
    """One row for each day, type, resource and item, or for each activity where a part is missing.

    Seconds add up, references unite, and attributes come from the row of the highest state,
    the earliest of those.
    """
    parts = ("activity_type", "resource_id", "item_id")
    whole = F.lit(True)
    for p in parts:
        whole = whole & (F.coalesce(F.col(p), F.lit("")) != "")
    refs = F.coalesce("output_refs", F.array().cast("array<string>"))
    state = F.when(F.col("result_state") == "completed", 2).when(F.col("result_state") == "has_output", 1).otherwise(0)
    rank = F.struct(F.greatest(state, F.when(F.size(refs) > 0, 1).otherwise(0)).alias("rank"), (-F.col("ord")).alias("early"))
    keyed = activities.withColumn("_key", F.when(whole, F.lit("")).otherwise(F.col("activity_id")))
    return keyed.groupBy("date", *parts, "_key").agg(
        F.sum(seconds()).alias("duration_seconds"), F.min("last_active_at").alias("started_at"), F.max("last_active_at").alias("last_active_at"),
        F.max_by("result_state", rank).alias("result_state"), F.max_by("domain", rank).alias("domain"), F.min_by("activity_id", "ord").alias("activity_id"),
        F.array_distinct(F.flatten(F.collect_list(refs))).alias("output_refs"), F.count(F.lit(1)).alias("merged"), F.min("ord").alias("ord"),
    ).drop("_key")


def effective(activities: DataFrame) -> DataFrame:
    return coalesced(activities).where(is_meaningful())


def totals(activities: DataFrame, *keys: str) -> DataFrame:
    return activities.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.sum(seconds()).alias("total_seconds"))


def totals_by_sets(activities: DataFrame) -> DataFrame:
    """By type, by domain and over all, in one pass."""
    rows = activities.select("activity_type", bucket().alias("domain"), seconds().alias("s"))
    return (
        rows.groupingSets([["activity_type"], ["domain"], []], "activity_type", "domain")
        .agg(F.count(F.lit(1)).alias("records"), F.sum("s").alias("total_seconds"))
        .select(F.when(F.col("activity_type").isNotNull(), "type").when(F.col("domain").isNotNull(), "domain").otherwise("all").alias("level"), F.coalesce("activity_type", "domain", F.lit("all")).alias("name"), "records", "total_seconds")
    )


def zero_filled(totals: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """A row for each of names, with zeros where totals has none."""
    spine = totals.sparkSession.createDataFrame([(n,) for n in names], f"{key} string")
    return spine.join(totals, key, "left").select(key, F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("total_seconds", F.lit(0)).alias("total_seconds"))


def daily_pivot(activities: DataFrame) -> DataFrame:
    """Seconds of each day, over all and by type."""
    by = [F.coalesce(F.sum(F.when(F.col("activity_type") == t, seconds())), F.lit(0)).alias(t) for t in TYPES]
    return activities.groupBy("date").agg(F.sum(seconds()).alias("total_seconds"), *by)


def slot(ts: str = "last_active_at") -> Column:
    """Morning from 5, afternoon from 12, evening from 18 o'clock; without an hour it is afternoon."""
    hour = F.coalesce(F.hour(ts), F.lit(14))
    return F.when((hour >= 5) & (hour < 12), "morning").when((hour >= 12) & (hour < 18), "afternoon").otherwise("evening")


def slots_by_day(activities: DataFrame) -> DataFrame:
    by = [F.coalesce(F.sum(F.when(slot() == s, seconds())), F.lit(0)).alias(s) for s in SLOTS]
    return activities.groupBy("date").agg(*by)


def golden_slot(activities: DataFrame) -> DataFrame:
    """The slot with most seconds, of equal ones the earliest, and its share; the evening with 0 when nothing was done."""
    s = slots_by_day(activities).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in SLOTS])
    total, best = F.col("morning") + F.col("afternoon") + F.col("evening"), F.greatest(*SLOTS)
    name = F.when(total == 0, "evening").when(F.col("morning") == best, "morning").when(F.col("afternoon") == best, "afternoon").otherwise("evening")
    return s.select(name.alias("slot"), best.alias("slot_seconds"), F.round(best * 100 / F.greatest(total, F.lit(1))).cast("long").alias("percent"))


def input_output_ratio(activities: DataFrame) -> DataFrame:
    read = F.col("activity_type") == "read"
    t = activities.agg(F.coalesce(F.sum(F.when(read, seconds())), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(~read, seconds())), F.lit(0)).alias("o"))
    percent = lambda x: F.round(F.col(x) * 100 / F.greatest(F.col("i") + F.col("o"), F.lit(1))).cast("long")
    return t.select(F.col("i").alias("input_seconds"), F.col("o").alias("output_seconds"), percent("i").alias("input_percent"), percent("o").alias("output_percent"))


def subject_balance(activities: DataFrame, goal: Sequence[int] = (60, 20, 20), floor: int = 40) -> DataFrame:
    """Shares of the three subjects, the third as what is left, and 100 less half their distance from the goal."""
    by = [F.coalesce(F.sum(F.when(bucket() == d, seconds())), F.lit(0)).alias(d) for d in DOMAINS]
    t = activities.agg(*by).withColumn("all", F.greatest(F.lit(1), F.col("medicine") + F.col("politics") + F.col("english")))
    t = t.select(*[F.round(F.col(d) * 100 / F.col("all")).cast("long").alias(d) for d in DOMAINS[:2]], F.col("english").alias("third"))
    t = t.withColumn("english", F.when(F.col("medicine") + F.col("politics") + F.col("third") == 0, 0).otherwise(F.greatest(F.lit(0), 100 - F.col("medicine") - F.col("politics"))))
    distance = sum((F.abs(F.col(d) - g) for d, g in zip(DOMAINS, goal, strict=True)), F.lit(0))
    return t.select(*[f"{d}" for d in DOMAINS], F.greatest(F.lit(floor), 100 - F.round(distance / 2)).cast("long").alias("score"))


def recent_resources(activities: DataFrame, most: int = 5) -> DataFrame:
    """The last resources worked on, each once; reviews and blank ones are left out."""
    last = Window.partitionBy("domain", "resource_id").orderBy(F.desc("last_active_at"), F.desc("ord"))
    rows = activities.where((F.col("activity_type") != "review") & (F.coalesce("resource_id", F.lit("")) != ""))
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1").orderBy(F.desc("last_active_at"), F.desc("ord")).limit(most)


def continue_target(activities: DataFrame) -> DataFrame:
    """The last activity that is not a completed review and has a resource and an item."""
    open_ = activities.where(~is_completed_review() & (F.coalesce("resource_id", F.lit("")) != "") & (F.coalesce("item_id", F.lit("")) != ""))
    return open_.agg(F.max_by(F.struct("activity_id", "activity_type", "resource_id", "item_id"), F.struct("last_active_at", "ord")).alias("x")).where("x is not null").select("x.*")


def meaningful_days(activities: DataFrame) -> DataFrame:
    return coalesced(activities).where(is_meaningful(include_review=False)).select("date").distinct()


def pending_review_day(activities: DataFrame, reviewed: DataFrame, day: DataFrame) -> DataFrame:
    """The last meaningful day before as_of that is not among the reviewed ones. reviewed: (date); day: one row (as_of)."""
    open_ = meaningful_days(activities).join(reviewed, "date", "left_anti").crossJoin(F.broadcast(day)).where("date < as_of")
    return open_.agg(F.max("date").alias("pending_day"))
