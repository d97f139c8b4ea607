"""Uniform shuffle into shards of exact size by a communication matrix.

Rows lie in BLOCKS hash blocks. How many rows of a block go to each shard is
drawn exactly, from the multivariate hypergeometric law: the counts that a
uniform permutation of all rows would give. A block then permutes its own rows,
deals them out by its row of the matrix, and each shard permutes what it got.
No step orders all rows, and the matrix has a fixed size.

Everything is DataFrame and SQL functions. Defined results: null text counts as
an empty one, a null doc_id is a value like any other, repeated rows are rows of
their own, an empty table gives no rows, and further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import written

SUPER = 32
SUB = 32
BLOCKS = SUPER * SUB
BUCKETS = 64


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def hypergeometric_sql(total: str, good: str, draws: str, u: str) -> str:
    """SQL for the number of good ones among draws out of total, by inversion of the uniform u.

    The probabilities start at the mode and follow the ratio of neighbours; beyond
    12 standard deviations they are below any double's precision.
    """
    ratio = "((e.g - {k}) * (e.n - {k}) / (({k} + 1D) * (e.t - e.g - e.n + {k} + 1D)))"
    up, down = ratio.format(k="k"), f"(1D / {ratio.format(k='(k - 1)')})"
    none = "CAST(array() AS ARRAY<BIGINT>)"
    ups, downs = f"IF(e.top > e.m, sequence(e.m, e.top - 1), {none})", f"IF(e.low < e.m, sequence(e.m, e.low + 1, -1L), {none})"
    mass = "aggregate({ks}, named_struct('p', 1D, 's', 0D), (a, k) -> named_struct('p', a.p * {r}, 's', a.s + a.p * {r}), a -> a.s)"
    walk = "aggregate({ks}, named_struct('p', 1D, 'c', {c}, 'x', CAST(NULL AS BIGINT)), (a, k) -> named_struct('p', a.p * {r}, 'c', a.c + a.p * {r}, 'x', coalesce(a.x, IF(a.c + a.p * {r} > f.y, k + {s}, NULL))), a -> coalesce(a.x, {end}))"
    pick = f"""CASE WHEN f.y <= 1D THEN e.m
        WHEN f.y <= 1D + f.above THEN {walk.format(ks=ups, c="1D", r=up, s="1L", end="e.top")}
        ELSE {walk.format(ks=downs, c="1D + f.above", r=down, s="-1L", end="e.low")} END"""
    sums = f"named_struct('above', {mass.format(ks=ups, r=up)}, 'below', {mass.format(ks=downs, r=down)})"
    scaled = "named_struct('above', b.above, 'y', e.u * (1D + b.above + b.below))"
    sd = "sqrt(greatest(0D, d.n * (d.g / greatest(d.t, 1D)) * (1D - d.g / greatest(d.t, 1D)) * ((d.t - d.n) / greatest(d.t - 1D, 1D))))"
    mode = "CAST(greatest(d.lo, least(d.hi, floor((d.n + 1D) * (d.g + 1D) / (d.t + 2D)))) AS BIGINT)"
    width = f"CAST(ceil(12D * {sd}) + 12 AS BIGINT)"
    e = "named_struct('t', d.t, 'g', d.g, 'n', d.n, 'u', d.u, 'm', c.m, 'low', greatest(d.lo, c.m - c.w), 'top', least(d.hi, c.m + c.w))"
    d = "named_struct('t', CAST(i.t AS DOUBLE), 'g', CAST(i.g AS DOUBLE), 'n', CAST(i.n AS DOUBLE), 'u', i.u, 'lo', greatest(0L, i.n + i.g - i.t), 'hi', least(i.n, i.g))"
    inner = _let(f"named_struct('m', {mode}, 'w', {width})", "c", _let(e, "e", _let(sums, "b", _let(scaled, "f", pick))))
    return _let(f"named_struct('t', {total}, 'g', {good}, 'n', {draws}, 'u', {u})", "i", _let(d, "d", inner))


def matrix_sql(counts: str, room: str, shards: int, key: str) -> str:
    """SQL for an array of rows, one for each of counts: how many go to each shard, given each shard's room."""
    u = f"((pmod(xxhash64({key}, x, s), 4503599627370496L) + 0.5D) / 4503599627370496D)"
    draw = hypergeometric_sql("r.rest", "q.room[s]", "r.left", u)
    deal = _let(draw, "v", "named_struct('rest', r.rest - q.room[s], 'left', r.left - v, 'row', concat(r.row, array(v)))")
    row = f"""aggregate(sequence(0, {shards - 1}), named_struct('rest', aggregate(q.room, 0L, (z, y) -> z + y), 'left', {counts}[x], 'row', CAST(array() AS ARRAY<BIGINT>)),
        (r, s) -> {deal}, r -> r.row)"""
    step = _let(row, "w", "named_struct('room', zip_with(q.room, w, (y, z) -> y - z), 'rows', concat(q.rows, array(w)))")
    return f"""aggregate(sequence(0, size({counts}) - 1), named_struct('room', {room}, 'rows', CAST(array() AS ARRAY<ARRAY<BIGINT>>)),
        (q, x) -> {step}, q -> q.rows)"""


def communication_matrix(block_counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """(block, n) to (block, upto): upto[s] is how many of the block's rows go to shards 0 to s. BLOCKS rows at most.

    Drawn in two levels, so that the draws of SUPER groups of blocks run side by side.
    """
    spark = block_counts.sparkSession
    by_super = (
        spark.range(BLOCKS).select(F.col("id").cast("int").alias("block")).join(block_counts, "block", "left")
        .groupBy((F.col("block") / SUB).cast("int").alias("super"))
        .agg(F.array_sort(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).cast("long").alias("n")))).alias("subs"))
        .select("super", F.transform("subs", lambda x: x["n"]).alias("subs"))
    )
    total = "aggregate(counts, 0L, (a, b) -> a + b)"
    top = (
        by_super.groupBy().agg(F.array_sort(F.collect_list(F.struct("super", "subs"))).alias("all"))
        .select("all", F.expr("transform(all, x -> aggregate(x.subs, 0L, (a, b) -> a + b))").alias("counts"))
        .withColumn("room", F.expr(f"transform(sequence(0, {shards - 1}), s -> CAST({total} DIV {shards} + IF(s < {total} % {shards}, 1, 0) AS BIGINT))"))
        .select("all", F.expr(matrix_sql("counts", "room", shards, f"{seed}L, 'top'")).alias("rows"))
        .select(F.posexplode("rows").alias("super", "room"), "all")
        .select("super", "room", F.expr("all[super].subs").alias("subs"))
    )
    return (
        top.repartition(SUPER, "super")
        .select("super", F.posexplode(F.expr(matrix_sql("subs", "room", shards, f"{seed}L, super"))).alias("sub", "row"))
        .select((F.col("super") * SUB + F.col("sub")).alias("block"), F.expr("transform(row, (y, i) -> aggregate(slice(row, 1, i + 1), 0L, (a, b) -> a + b))").alias("upto"))
    )


def shard_rows(df: DataFrame, shards: int, text: str = "text", key: str = "doc_id", seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): a uniform shuffle of all rows, shard sizes at most one apart."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    own = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "doc_id", "text_crc32", "size")
    rows = rows.withColumn("block", F.pmod(own("block"), F.lit(BLOCKS)).cast("int"))
    matrix = communication_matrix(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")), shards, seed)
    local = Window.partitionBy("block").orderBy(own("local"), "doc_id", "text_crc32", "size")
    dealt = (
        rows.withColumn("rank", F.row_number().over(local)).join(F.broadcast(matrix), "block")
        .select("doc_id", "size", "text_crc32", F.expr("size(filter(upto, c -> c < rank))").alias("shard"))
    )
    dealt = written(dealt.withColumn("final", own("final")).withColumn("bucket", F.shiftrightunsigned("final", 58).cast("int")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("final", "doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("rank", F.row_number().over(within)).join(F.broadcast(offsets), ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def op3_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    out = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
