"""Search over typed collections, and fuzzy title matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = "[#*_>`|\\[\\]()!~-]+"


def hits(query: str, **weights: tuple[str, int]) -> Column:
    """Sum of the weights of the fields that hold the query. weights: any name=(column, weight)."""
    q = query.strip().lower()
    out = F.lit(0)
    for column, weight in weights.values():
        out = out + F.when(F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(q)), weight).otherwise(0)
    return out if q else F.lit(0)


def snippet(text: Column, query: str, width: int = 70) -> Column:
    """The text around the first hit, without markup, with an ellipsis where it is cut."""
    q = query.strip().lower()
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, MARKS, ""), "[ \\t\\n\\x0B\\f\\r]+", " "))
    at = F.greatest(F.instr(F.lower(plain), F.lit(q)), F.lit(1))
    start = F.greatest(F.lit(1), at - width // 2)
    end = start + width + len(q)
    body = F.substring(plain, start, F.lit(width + len(q)))
    return F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(end <= F.length(plain), "…").otherwise(""))


def top(results: DataFrame, most: int) -> DataFrame:
    """The best results by score, then by source and place. results: (score, source_order, row_order, ...)."""
    return results.where("score > 0").orderBy(F.desc("score"), "source_order", "row_order").limit(most)


def contained_titles(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of non-blank titles of which one contains the other. (id, title) each.

    An equi-join on the pieces of the longer title, of the lengths that the other side has,
    takes the place of comparing all pairs. Titles are short, and so are there few lengths.
    """
    a, b = (d.where(F.length("title") > 0).select("id", "title") for d in (left, right))

    def inside(short: DataFrame, long: DataFrame, names: tuple[str, str]) -> DataFrame:
        lengths = short.agg(F.collect_set(F.length("title")).alias("lengths"))
        fits = long.crossJoin(F.broadcast(lengths)).select("id", "title", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("title"))
        starts = F.sequence(F.lit(1), F.length("title") - F.col("n") + 1)
        pieces = fits.select(F.col("id").alias(names[1]), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("title"), i, F.col("n"))))).alias("title"))
        return short.withColumnRenamed("id", names[0]).join(pieces, "title").select("left_id", "right_id")

    return inside(a, b, ("left_id", "right_id")).union(inside(b, a, ("right_id", "left_id"))).distinct()
