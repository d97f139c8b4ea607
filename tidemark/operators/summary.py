"""Summaries for a start page: insights by rule, levels and scales, shelves, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.activity import bucket, seconds
from tidemark.sources.shared import written


def insights(facts: DataFrame) -> DataFrame:
    """(kind, level, value) for one row of facts: medicine_percent, due, mastered, unresolved."""
    one = lambda when, kind, level, value: F.when(when, F.struct(F.lit(kind).alias("kind"), level.alias("level"), F.col(value).cast("long").alias("value")))
    yes = F.lit(True)
    rules = F.array(
        one(yes, "balance", F.when(F.col("medicine_percent") < 45, "warning").otherwise("positive"), "medicine_percent"),
        one(F.col("due") > 0, "recall", F.lit("urgent"), "due"),
        one((F.col("due") <= 0) & (F.col("mastered") > 0), "recall", F.lit("positive"), "mastered"),
        one(F.col("unresolved") > 0, "mistakes", F.lit("action"), "unresolved"),
    )
    return facts.select(F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("x")).select("x.*")


def log_level(count: Column, most: Column) -> Column:
    """0 to 4 on a scale of logarithms."""
    return F.when(count <= 0, 0).otherwise(F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(F.ln(count + 1) / F.ln(most + 1) * 4)))).cast("int")


def chart_top(most: Column, step: int = 1800, least: int = 7200) -> Column:
    return F.greatest(F.lit(least), F.ceil(most * 1.25 / step) * step).cast("long")


def daily_counters(activities: DataFrame) -> DataFrame:
    """Per day: opens, distinct resources, the longest one, whether a review was saved, and seconds of the most used resource."""
    per = activities.groupBy("date", "resource_id").agg(F.count(F.lit(1)).alias("n"), F.sum(seconds()).alias("s"), F.max(seconds()).alias("m"), F.bool_or(F.col("activity_type") == "review").alias("r"))
    return per.groupBy("date").agg(F.sum("n").alias("opens"), F.count(F.lit(1)).alias("resources"), F.max("m").alias("longest"), F.bool_or("r").alias("review_saved"), F.max("s").alias("most_seconds"))


def trimmed(rows: DataFrame, group: str, order: str, first: Column) -> DataFrame:
    """Rows from the first match of each group on, numbered anew; groups without a match stay whole."""
    start = F.min(F.when(first, F.col(order))).over(Window.partitionBy(group))
    kept = rows.withColumn("_start", start).where(F.col(order) >= F.coalesce("_start", F.col(order)))
    return kept.withColumn("number", F.row_number().over(Window.partitionBy(group).orderBy(order))).drop("_start")


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Rows of one page from 1 on; the last page for a number beyond it. The order must be total. Tasks keep their first rows only."""
    at = min(max(1, number), max(1, -(-rows.count() // size)))
    own = rows.orderBy(*order).offset((at - 1) * size).limit(size)
    return own.withColumn("place", F.row_number().over(Window.orderBy(*order)) + (at - 1) * size).withColumn("page", F.lit(at))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place from 1 on in a total order: by ranges, each numbered in a task of its own, and the sizes of the ranges before."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(sizes), "_range").withColumn(name, own + F.col("_before")).drop("_range", "_before")


def shelf(items: DataFrame, recents: DataFrame, key: str, default: str) -> DataFrame:
    """Items that were used last come first, the rest in their default order. recents: (key, ord), the largest last used."""
    last = recents.groupBy(key).agg(F.max("ord").alias("used"))
    rows = items.join(last, key, "left")
    return numbered(rows, "place", F.desc_nulls_last("used"), F.col(default), F.col(key)).drop("used")


def month_labels(weeks: DataFrame) -> DataFrame:
    """(week_start, label): the month where it differs from that of the week before, else empty."""
    month = F.month("week_start")
    before = F.lag(month).over(Window.orderBy("week_start"))
    return weeks.select("week_start", F.when(before.isNull() | (before != month), F.concat(month.cast("string"), F.lit("月"))).otherwise("").alias("label"))


def medicine_percent(activities: DataFrame) -> DataFrame:
    s = F.sum(seconds())
    return activities.agg(F.round(F.coalesce(F.sum(F.when(bucket() == "medicine", seconds())), F.lit(0)) * 100 / F.greatest(F.lit(1), F.coalesce(s, F.lit(0)))).alias("medicine_percent"))
