"""JSON of any shape, as VARIANT values: one canonical form for hashing, and the shape without the values.

A text that is no JSON, or has a key twice in one object, has no canonical form: null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys at every depth; non-ASCII letters stay, numbers lose zeros at their end."""
    return F.to_json(F.try_parse_json(text))


def canonical_sha256(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def kind(value: Column) -> Column:
    """object, array, string, number, boolean, null, or other."""
    t = F.schema_of_variant(value)
    return (
        F.when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean")
        .when(t == "VOID", "null").when(t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("other")
    )


def shapes(rows: DataFrame, text: str, depth: int = 2) -> DataFrame:
    """(path, kind, n, longest) over all texts: the kinds at each path of keys down to depth, how often, and the longest array there.

    An element of an array has the path of its array and []; arrays of arrays go on. Texts without canonical form are of kind invalid.
    """
    spark = rows.sparkSession
    parsed = rows.select(F.try_parse_json(text).alias("value"), F.col(text).isNotNull().alias("given"))
    level = parsed.where("value IS NOT NULL").select(F.lit("$").alias("path"), "value")
    out = parsed.where("value IS NULL AND given").select(F.lit("$").alias("path"), F.lit("invalid").alias("kind"), F.lit(None).cast("long").alias("size"))
    for at in range(depth + 1):
        found = level.withColumn("kind", kind(F.col("value")))
        size = F.when(F.col("kind") == "array", F.size(F.expr("try_variant_get(value, '$', 'array<variant>')")))
        out = out.unionByName(found.select("path", "kind", size.cast("long").alias("size")))
        if at < depth:
            below = spark.sql("SELECT path, kind, e.key, e.value FROM {found} AS t, LATERAL variant_explode(t.value) AS e", found=found.where("kind IN ('object', 'array')"))
            level = below.select(F.when(F.col("kind") == "array", F.concat("path", F.lit("[]"))).otherwise(F.concat_ws(".", "path", "key")).alias("path"), "value")
    return out.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("longest"))
