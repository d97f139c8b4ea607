"""Trees, alias chains, ordered intervals and references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import written


def alias_closure(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Each old id with the id that its chain of aliases ends in; null if the chain is a cycle or ends in an unknown id.

    edges: (legacy_id, current_id), one for each legacy_id; known: (id). Hops double each round, so that a
    chain of n aliases takes log2(n) joins. Rounds end when no row moves on, or after as many hops as there
    are edges, which no chain without a cycle outlasts.
    """
    steps = written(edges.where("legacy_id != current_id").select(F.col("legacy_id").alias("id"), F.col("current_id").alias("to")))
    hops, most = 1, steps.count()
    while hops < most:
        on = steps.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moved = F.coalesce(F.col("further") != F.col("to"), F.lit(False)).alias("moved")
        steps = written(steps.join(on, "to", "left").select("id", F.coalesce("further", "to").alias("to"), moved))
        hops *= 2
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    # what can still go on is in a cycle
    cyclic = edges.select(F.col("legacy_id").alias("to"), F.lit(True).alias("cyclic"))
    good = known.select(F.col("id").alias("to"), F.lit(True).alias("good"))
    ends = steps.join(cyclic, "to", "left").join(good, "to", "left")
    return ends.select(F.col("id").alias("legacy_id"), F.when(F.col("cyclic").isNull() & F.col("good"), F.col("to")).alias("canonical_id"))


def _climbed(rows: DataFrame, most: int, **add) -> DataFrame:
    """rows (id, up, ...) with up doubled until it is null or after most hops; add: what a hop adds to columns, from its own (r_) and the upper (s_) row.

    Both sides of a join have a row for each node and are merged: their Parquet files are small enough to seem fit for a broadcast.
    """
    hops = 1
    while hops <= most and not rows.where("up is not null").isEmpty():
        own, upper = (rows.select(*[F.col(c).alias(p + c) for c in rows.columns]) for p in ("r_", "s_"))
        met = own.join(upper.hint("merge"), F.col("r_up") == F.col("s_id"), "left")
        on = lambda c: F.when(F.col("r_up").isNull(), F.col("r_" + c)).otherwise(F.expr(add[c]))  # noqa: B023, E731
        rows = written(met.where("r_up is null OR s_id is not null").select(F.col("r_id").alias("id"), F.when(F.col("r_up").isNotNull(), F.col("s_up")).alias("up"), *[on(c).alias(c) for c in add]))
        hops *= 2
    return rows.where("up is null").drop("up")


def breadcrumbs(spark, nodes: DataFrame) -> DataFrame:
    """Path of titles from the root to each node, its depth and its root. nodes: (id, parent_id, title), ids unique.

    Hops double each round, so that a tree of depth d takes log2(d) joins. Nodes under a cycle or a missing parent have no
    root and no row; they are left out before paths are put together.
    """
    nodes = written(nodes.select("id", "parent_id", F.col("title").cast("string").alias("title")))
    most = nodes.count()
    rooted = _climbed(nodes.select("id", F.col("parent_id").alias("up")), most)
    start = nodes.join(rooted.hint("merge"), "id").select("id", F.col("parent_id").alias("up"), F.col("title").alias("path"), F.lit(1).alias("depth"), F.col("id").alias("root"))
    return _climbed(written(start), most, path="concat(s_path, ' / ', r_path)", depth="r_depth + s_depth", root="s_root")


def cyclic_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose parents never end, those of a missing parent aside. nodes: (id, parent_id)."""
    known = nodes.select(F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    up = nodes.join(known.hint("merge"), "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("up"))
    return nodes.select("id").join(_climbed(written(up), nodes.count()).hint("merge"), "id", "left_anti")


def missing_parents(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")).hint("merge"), "parent_id", "left_anti")


def coverage(intervals: DataFrame, group: str) -> DataFrame:
    """Gaps and overlaps of inclusive (start, stop) intervals against what all earlier ones have covered."""
    before = Window.partitionBy(group).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    rows = intervals.withColumn("covered", F.max("stop").over(before))
    kind = F.when(F.col("start") > F.col("covered") + 1, "gap").when(F.col("start") <= F.col("covered"), "overlap")
    return rows.withColumn("finding", kind).where("finding is not null").select(group, "start", "stop", "covered", "finding")


def spans(markers: DataFrame, group: str, at: str, last: str) -> DataFrame:
    """A span from each marker to the place before the next one; the last one ends at the group's last place."""
    after = F.lead(at).over(Window.partitionBy(group).orderBy(at))
    return markers.select(group, F.col(at).alias("start"), F.coalesce(after - 1, F.col(last)).alias("stop"))


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, value: str) -> DataFrame:
    """left with the value of the last row of right at or before it. Both sides go through one ordered window of the group."""
    both = left.select(group, at, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(right.select(group, at, value, F.lit(0).alias("side")))
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy(group).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn(value, seen).where("side = 1").drop("side")


def number_gaps(rows: DataFrame, parent: str, number: str) -> DataFrame:
    """Siblings whose number is not their place among them."""
    place = F.row_number().over(Window.partitionBy(parent).orderBy(number))
    return rows.withColumn("place", place).where(F.col(number) != F.col("place")).select(parent, number, "place")


def first_of(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keys of child, each once, that parent lacks."""
    return child.select(key).where(F.col(key).isNotNull()).distinct().join(parent.select(key), key, "left_anti")


def mismatches(declared: DataFrame, found: DataFrame, key: str, *attributes: str) -> DataFrame:
    """Declared keys that are missing, and those of which an attribute differs; two nulls are equal."""
    other = found.select(key, *[F.col(a).alias(f"found_{a}") for a in attributes], F.lit(True).alias("here"))
    rows = declared.join(other, key, "left")
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.col(f"found_{a}"))
    return rows.withColumn("finding", F.when(F.col("here").isNull(), "missing").when(~same, "different")).where("finding is not null").select(key, "finding")
