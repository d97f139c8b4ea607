"""Where marks that open and close lie in a text, how deep any place is in them, and what a cut-out span lacks.

Places are counted in characters from 0. A close without an open counts as nothing. A mark counts for the places after its first character.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tag_marks(docs: DataFrame, key: str, text: str, tag: str) -> DataFrame:
    """(key, at, delta, size): each <tag ...> (1) and </tag> (-1) with its length, in any case."""
    pattern = rf"(?i)</?{tag}(?=[\s/>])[^>]*>"
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.arrays_zip(F.split(body, pattern, -1).alias("between"), F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("mark"))
    rows = docs.select(key, F.posexplode(parts).alias("i", "p")).select(key, "i", F.length("p.between").alias("gap"), F.col("p.mark").alias("mark"))
    upto = Window.partitionBy(key).orderBy("i")  # the parts of one text
    at = F.sum(F.col("gap") + F.coalesce(F.length("mark"), F.lit(0))).over(upto) - F.length("mark")
    return rows.select(key, at.alias("at"), F.when(F.startswith("mark", F.lit("</")), -1).otherwise(1).alias("delta"), F.length("mark").alias("size")).where("size IS NOT NULL")


def depth_at(marks: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """places (key, at) with depth, and last_open and last_close: the last such mark before the place, open or not any more."""
    points = marks.select(key, "at", "delta").unionByName(places.select(key, F.col("at").cast("long").alias("at")).distinct().withColumn("delta", F.lit(0)))
    upto = Window.partitionBy(key).orderBy("at", F.abs("delta")).rowsBetween(Window.unboundedPreceding, 0)
    level = points.withColumn("level", F.sum("delta").over(upto))
    low = F.least(F.min("level").over(upto), F.lit(0))
    last = lambda sign: F.last(F.when(F.col("delta") == sign, F.col("at")), ignorenulls=True).over(upto)
    found = level.select(key, "at", "delta", (F.col("level") - low).alias("depth"), last(1).alias("last_open"), last(-1).alias("last_close"))
    return found.where("delta = 0").drop("delta")


def span_wrappers(docs: DataFrame, key: str, text: str, spans: DataFrame, tag: str) -> DataFrame:
    """spans (key, start, end) with prefix and suffix: the tags that make the cut-out text whole, and the last open mark before its start."""
    marks = tag_marks(docs, key, text, tag)
    places = depth_at(marks, spans.select(key, F.col("start").alias("at")).unionByName(spans.select(key, F.col("end").alias("at"))), key)
    first = places.select(key, F.col("at").alias("start"), F.col("depth").alias("_before"), "last_open")
    last = places.select(key, F.col("at").alias("end"), F.col("depth").alias("_after"))
    rows = spans.join(first, [key, "start"]).join(last, [key, "end"])
    return rows.select(key, "start", "end", F.expr(f"repeat('<{tag}>', cast(_before AS int))").alias("prefix"), F.expr(f"repeat('</{tag}>', cast(_after AS int))").alias("suffix"), "last_open")


def span_starts(docs: DataFrame, key: str, text: str, places: DataFrame, outer: str, inner: str) -> DataFrame:
    """places (key, line_start, at) with start: where a span that is to begin at a place should be cut.

    At the last inner mark, if an outer one starts after line_start and the inner one does not follow it at once (a first row
    stays with its table); else at the outer mark; without an outer mark in the line, at line_start.
    """
    found = lambda tag, name: depth_at(tag_marks(docs, key, text, tag), places, key).select(key, "at", F.col("last_open").alias(name))
    sizes = tag_marks(docs, key, text, outer).where("delta = 1").select(key, F.col("at").alias("outer"), "size")
    rows = places.join(found(outer, "outer"), [key, "at"]).join(found(inner, "inner"), [key, "at"]).join(sizes, [key, "outer"], "left")
    within = F.col("outer") >= F.col("line_start")
    own = within & (F.col("inner") > F.col("outer") + F.col("size") + 1)
    return rows.select(key, "line_start", "at", F.when(own, F.col("inner")).when(within, F.col("outer")).otherwise(F.col("line_start")).alias("start"))
