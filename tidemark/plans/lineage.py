"""Queries over trees, aliases, intervals and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lineage as L
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_EDGES = "SELECT 'p' || p_partkey AS legacy_id, 'p' || CASE WHEN p_partkey % 50 = 49 THEN p_partkey - 7 WHEN p_partkey % 50 = 42 THEN p_partkey + 7 ELSE p_partkey + 1 END AS current_id FROM part WHERE p_type <> 'SMALL'"


@query(f"""WITH RECURSIVE e AS ({_EDGES}), known AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size > 12),
w AS (SELECT legacy_id, current_id AS here, 1 AS hops FROM e UNION ALL SELECT w.legacy_id, e.current_id, hops + 1 FROM w JOIN e ON e.legacy_id = w.here WHERE hops < 60),
l AS (SELECT legacy_id, arg_max(here, hops) AS here FROM w GROUP BY 1)
SELECT legacy_id, CASE WHEN here IN (SELECT legacy_id FROM e) OR here NOT IN (SELECT id FROM known) THEN NULL ELSE here END AS canonical_id FROM l""")
def alias_closure(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    to = F.when(k % 50 == 49, k - 7).when(k % 50 == 42, k + 7).otherwise(k + 1)
    edges = part.where("p_type <> 'SMALL'").select(F.concat(F.lit("p"), k).alias("legacy_id"), F.concat(F.lit("p"), to).alias("current_id"))
    return L.alias_closure(edges, part.where("p_size > 12").select(F.concat(F.lit("p"), k).alias("id")))


def _nodes(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    key = lambda a, c: F.concat(F.lit(a), c)
    regions = t("region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    nations = t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"))
    return regions.unionByName(nations).unionByName(t("customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("title")))


@query("""WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, r_name AS title FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
down AS (SELECT id, title AS path, 1 AS depth, id AS root FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, path || ' / ' || title, depth + 1, root FROM nodes n JOIN down d ON n.parent_id = d.id)
SELECT id, path, depth, root FROM down""")
def tree_breadcrumb(spark, sf_dir):
    return L.breadcrumbs(spark, _nodes(spark, sf_dir))


_INTERVALS = "SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 300) AS BIGINT) AS stop FROM events"


@query(f"""WITH i AS ({_INTERVALS}), c AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered FROM i)
SELECT user_id, start, stop, covered, CASE WHEN start > covered + 1 THEN 'gap' ELSE 'overlap' END AS finding FROM c WHERE start > covered + 1 OR start <= covered""")
def interval_gap_overlap(spark, sf_dir):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return L.coverage(table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + F.floor(F.col("value") * 300)).alias("stop")), "user_id")


@query("""WITH m AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last, role FROM conversations)
SELECT conv_id, turn AS start, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - 1, last) AS stop FROM m WHERE role = 'user'""")
def span_from_markers(spark, sf_dir):
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").withColumn("last", F.max("turn").over(Window.partitionBy("conv_id")))
    return L.spans(turns.where("role = 'user'"), "conv_id", "turn", "last")


@query("""WITH e AS (SELECT user_id, event_id, event_type FROM events) SELECT a.user_id, a.event_id, (SELECT max(b.event_id) FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'signup' AND b.event_id <= a.event_id) AS line
FROM e a WHERE event_type = 'error'""")
def asof_line_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    marks = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("event_id").alias("line"))
    return L.as_of(e.where("event_type = 'error'"), marks, "user_id", "event_id", "line")


@query("WITH p AS (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT * FROM p WHERE l_linenumber <> place")
def sibling_number_gap(spark, sf_dir):
    return L.number_gaps(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct(), "l_orderkey", "l_linenumber")


@query("SELECT conv_id, role, min(turn) AS turn FROM conversations GROUP BY 1, 2")
def first_marker_dedup(spark, sf_dir):
    return L.first_of(table(spark, sf_dir, "conversations").select("conv_id", "role", "turn"), ["conv_id", "role"], "turn")


@query("SELECT p_brand, p_name, count(*) AS copies FROM part GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sibling(spark, sf_dir):
    return L.duplicates(table(spark, sf_dir, "part"), "p_brand", "p_name")


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def referential_orphans(spark, sf_dir):
    child = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    return L.orphans(child, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey")), "custkey")


@query("SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45 INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def set_disjointness(spark, sf_dir):
    formal = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("id"))
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("id")).intersect(formal)


@query("""WITH f AS (SELECT s_suppkey AS id, s_nationkey AS nation, 'Supplier' AS role FROM supplier), d AS (SELECT c_custkey AS id, c_nationkey AS nation FROM customer)
SELECT d.id, CASE WHEN f.id IS NULL THEN 'missing' ELSE 'different' END AS finding FROM d LEFT JOIN f USING (id) WHERE f.id IS NULL OR d.nation IS DISTINCT FROM f.nation""")
def source_attr_mismatch(spark, sf_dir):
    declared = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    return L.mismatches(declared, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), "id", "nation")
