"""Reviews of a day: work of several kinds as one list of sources, by subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sources(*typed: DataFrame) -> DataFrame:
    """Sources of all kinds as one table (subject, kind, id, characters, seconds, position)."""
    out = typed[0]
    for t in typed[1:]:
        out = out.unionByName(t)
    return out


def subject_groups(rows: DataFrame) -> DataFrame:
    """Per subject: sources, characters, seconds, whether any time was tracked; in the order of their first source."""
    g = rows.groupBy("subject").agg(
        F.count(F.lit(1)).alias("sources"), F.sum("characters").alias("characters"), F.sum("seconds").alias("seconds"), F.bool_or(F.col("seconds") > 0).alias("tracked"), F.min("position").alias("position")
    )
    # one row a subject, so that a single window is small
    return g.withColumn("ordinal", F.row_number().over(Window.orderBy("position", "subject"))).drop("position")


def unarchived(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Ids of each day and field that are not known, each once. ids: (date, field, id); known: (id)."""
    return ids.distinct().join(known.select("id").distinct(), "id", "left_anti").groupBy("date", "field").agg(F.count(F.lit(1)).alias("missing"))


def inventory(rows: DataFrame, key: str) -> DataFrame:
    """Rows, characters, blank and distinct contents of each group of (key, text)."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("files"), F.sum(F.length("text")).alias("characters"), F.count_if(F.trim("text") == "").alias("blank"), F.count_distinct(F.sha2("text", 256)).alias("contents"))
