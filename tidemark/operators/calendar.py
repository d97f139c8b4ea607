"""Calendar spines over day facts: heat map, streak, history, week rollup, goals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.activity import DOMAINS, bucket, seconds


def iso_week(date: str | Column) -> Column:
    """2027-01-01 is in 2026-W53: the year of a week is that of its Thursday."""
    d = F.col(date) if isinstance(date, str) else date
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.weekofyear(d))


def week_bounds(week: Column) -> tuple[Column, Column]:
    """Monday and Sunday of YYYY-Www; null for a week that its year lacks. 4 January is always in week 1."""
    year, number = F.try_to_number(F.substring(week, 1, 4), F.lit("9999")).cast("int"), F.try_to_number(F.substring(week, 7, 2), F.lit("99")).cast("int")
    monday = F.date_add(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date"), ((number - 1) * 7).cast("int"))
    ok = iso_week(monday) == week
    return F.when(ok, monday), F.when(ok, F.date_add(monday, 6))


def heatmap(days: DataFrame, day: DataFrame, weeks: int) -> DataFrame:
    """weeks * 7 days from a Monday on, up to the Sunday after as_of. days: (date, total_seconds)."""
    monday = F.date_sub(F.date_trunc("week", "as_of").cast("date"), 7 * (weeks - 1))
    spine = day.select("as_of", F.explode(F.sequence(monday, F.date_add(monday, 7 * weeks - 1))).alias("date"))
    return spine.join(days, "date", "left").select("date", F.coalesce("total_seconds", F.lit(0)).alias("total_seconds"), (F.col("date") > F.col("as_of")).alias("future"))


def heat_levels(map_: DataFrame, least: int = 3600) -> DataFrame:
    """Level 0 to 4 against the largest day, which counts as least at the lowest."""
    top = map_.agg(F.greatest(F.lit(least), F.max("total_seconds")).alias("top"))
    share = F.col("total_seconds") / F.col("top")
    level = F.when(F.col("total_seconds") <= 0, 0).when(share < 0.18, 1).when(share < 0.45, 2).when(share < 0.75, 3).otherwise(4)
    return map_.crossJoin(F.broadcast(top)).select("date", "total_seconds", "future", level.alias("level"))


def streak(active: DataFrame, day: DataFrame) -> DataFrame:
    """Length of the run of active days that ends at as_of, or on the day before it. active: (date)."""
    rows = active.select("date").distinct().crossJoin(F.broadcast(day)).where("date <= as_of")
    # the island of a day: dates less their rank; one row a day, so a single window is small
    island = rows.withColumn("island", F.date_sub("date", F.row_number().over(Window.orderBy("date"))))
    runs = island.groupBy("island", "as_of").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))
    return runs.where(F.datediff("as_of", "last") <= 1).agg(F.coalesce(F.max("n"), F.lit(0)).alias("streak"))


def history(days: DataFrame, day: DataFrame, n: int) -> DataFrame:
    """The last n days up to as_of in order, 1 to 400, zeros included."""
    n = max(1, min(400, n))
    spine = day.select(F.explode(F.sequence(F.date_sub("as_of", n - 1), "as_of")).alias("date"))
    return spine.join(days, "date", "left").select("date", F.coalesce("total_seconds", F.lit(0)).alias("total_seconds"), F.round(F.coalesce("total_seconds", F.lit(0)) / 60, 1).alias("minutes"))


def trend(activities: DataFrame, day: DataFrame, n: int = 7) -> DataFrame:
    """For each of the last n days: seconds of each subject, and how many activities left an output."""
    by = [F.coalesce(F.sum(F.when(bucket() == d, seconds())), F.lit(0)).alias(d) for d in DOMAINS]
    outputs = F.count_if(F.size("output_refs") > 0).alias("outputs")
    facts = activities.groupBy("date").agg(*by, outputs)
    spine = day.select(F.explode(F.sequence(F.date_sub("as_of", n - 1), "as_of")).alias("date"))
    return spine.join(facts, "date", "left").select("date", F.weekday("date").alias("weekday"), *[F.coalesce(c, F.lit(0)).alias(c) for c in (*DOMAINS, "outputs")])


def week_rollup(activities: DataFrame) -> DataFrame:
    """Records and seconds of each day, week and over all."""
    rows = activities.select(iso_week("date").alias("week"), "date", seconds().alias("s"))
    return rows.rollup("week", "date").agg(F.count(F.lit(1)).alias("records"), F.sum("s").alias("total_seconds"))


def log_entries(activities: DataFrame) -> DataFrame:
    """A log entry for each day: seconds of each subject and of others, subjects and resources worked on."""
    by = [F.coalesce(F.sum(F.when(bucket() == d, seconds())), F.lit(0)).alias(d) for d in (*DOMAINS, "other")]
    return activities.groupBy("date").agg(F.sum(seconds()).alias("total_seconds"), *by, F.count_distinct("domain").alias("subjects"), F.count_distinct("resource_id").alias("resources"))


def goal_progress(activities: DataFrame, goal_seconds: int) -> DataFrame:
    """Per day: seconds, reading seconds of each subject, distinct items of each kind of work, and percent of the goal up to 100."""
    reading = [F.coalesce(F.sum(F.when((bucket() == d) & (F.col("activity_type") == "read"), seconds())), F.lit(0)).alias(f"{d}_reading") for d in DOMAINS]
    items = [F.count_distinct(F.when(F.col("activity_type") == t, F.concat_ws("/", "resource_id", "item_id"))).alias(f"{t}_items") for t in ("objective_practice", "subjective_practice")]
    percent = F.least(F.lit(100), F.greatest(F.lit(0), F.round(F.sum(seconds()) * 100 / goal_seconds).cast("long"))).alias("percent")
    return activities.groupBy("date").agg(F.sum(seconds()).alias("total_seconds"), *reading, *items, percent)


def vocab_totals(words: DataFrame, day: DataFrame) -> DataFrame:
    """words: (date, words_count)."""
    return words.crossJoin(F.broadcast(day)).agg(
        F.coalesce(F.sum("words_count"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.when(F.col("date") == F.col("as_of"), F.col("words_count"))), F.lit(0)).alias("today"), F.count_if(F.col("words_count") > 0).alias("active_days")
    )
