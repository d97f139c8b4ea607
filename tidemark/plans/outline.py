"""Queries of outline checks, numbering, agreeing tables and changes of records. Orders are books, their lines are pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lineage as L
from tidemark.operators import outline as O
from tidemark.operators import state as S
from tidemark.plans.registry import query
from tidemark.sources.tables import table

_PAGES_SQL = """pages AS (SELECT l_orderkey AS book_id, l_linenumber + CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END AS "order", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page,
  l_linenumber * 10 - 9 + CASE WHEN l_partkey % 7 = 0 THEN 2 ELSE 0 END AS start, l_linenumber * 10 + CASE WHEN l_suppkey % 5 = 0 THEN 3 WHEN l_suppkey % 11 = 0 THEN -12 ELSE 0 END AS "end", CAST(floor(l_extendedprice) AS BIGINT) AS chars FROM lineitem)"""


def _pages(spark, sf_dir):
    from pyspark.sql import Window

    li = table(spark, sf_dir, "lineitem")
    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    n = F.col("l_linenumber").cast("long")
    return li.select(
        F.col("l_orderkey").alias("book_id"), (n + F.when(F.col("l_partkey") % 9 == 0, 1).otherwise(0)).alias("order"), page.cast("long").alias("page"),
        (n * 10 - 9 + F.when(F.col("l_partkey") % 7 == 0, 2).otherwise(0)).alias("start"),
        (n * 10 + F.when(F.col("l_suppkey") % 5 == 0, 3).when(F.col("l_suppkey") % 11 == 0, -12).otherwise(0)).alias("end"), F.floor("l_extendedprice").cast("long").alias("chars"),
    )


@query(f"""WITH {_PAGES_SQL}, k AS (SELECT *, max("end") OVER w AS covered, lag("order") OVER (PARTITION BY book_id ORDER BY "order", page) AS previous FROM pages WINDOW w AS (PARTITION BY book_id ORDER BY "order", page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT book_id, page, 'page_range' AS code FROM k WHERE "end" < start UNION ALL SELECT book_id, page, 'page_order_gap' FROM k WHERE "order" > coalesce(previous, 0) + 1 UNION ALL SELECT book_id, page, 'page_duplicate' FROM k WHERE "order" = previous
  UNION ALL SELECT book_id, page, 'source_gap' FROM k WHERE start > coalesce(covered, 0) + 1 UNION ALL SELECT book_id, page, 'source_overlap' FROM k WHERE start <= covered UNION ALL SELECT book_id, page, 'short_page' FROM k WHERE chars < 300
  UNION ALL SELECT book_id, page, 'long_page' FROM k WHERE chars > 30000 UNION ALL SELECT book_id, NULL, 'source_tail' FROM pages JOIN orders ON o_orderkey = book_id GROUP BY book_id HAVING max("end") < max(o_custkey % 60)) SELECT book_id, page, code FROM f""")
def outline_page_findings(spark, sf_dir):
    last = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("book_id"), (F.col("o_custkey") % 60).alias("last"))
    return O.page_findings(_pages(spark, sf_dir), last)


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'N')")
def chapters_without_pages(spark, sf_dir):
    chapters = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").distinct()
    return O.without_pages(chapters, table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("""WITH n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN p_partkey + 1 WHEN p_partkey % 13 = 1 AND p_partkey > 1 THEN p_partkey - 1 WHEN p_partkey % 17 = 0 THEN -1 ELSE p_partkey - p_partkey % 50 END AS parent FROM part),
m AS (SELECT id, CASE WHEN parent IN (SELECT id FROM n) THEN parent END AS up, parent IS NOT NULL AND parent NOT IN (SELECT id FROM n) AS missing FROM n)
SELECT id, 'node_cycle' AS code FROM (WITH RECURSIVE r AS (SELECT id FROM m WHERE up IS NULL UNION SELECT m.id FROM m JOIN r ON m.up = r.id) SELECT id FROM m WHERE id NOT IN (SELECT id FROM r)) UNION ALL SELECT id, 'node_parent_missing' FROM m WHERE missing""")
def node_tree_findings(spark, sf_dir):
    k = F.col("p_partkey")
    parent = F.when(k % 50 == 0, None).when(k % 13 == 0, k + 1).when((k % 13 == 1) & (k > 1), k - 1).when(k % 17 == 0, -1).otherwise(k - k % 50)
    nodes = table(spark, sf_dir, "part").select(k.alias("id"), parent.alias("parent_id"))
    return L.cyclic_nodes(nodes).select("id", F.lit("node_cycle").alias("code")).unionByName(L.missing_parents(nodes).select("id", F.lit("node_parent_missing").alias("code")))


@query("""WITH n AS (SELECT s_suppkey, s_nationkey, CAST(s_acctbal AS BIGINT) % 6 AS n FROM supplier), k AS (SELECT *, lag(n) OVER (PARTITION BY s_nationkey ORDER BY n, s_suppkey) AS b FROM n)
SELECT s_nationkey, s_suppkey, CASE WHEN b IS NULL THEN 'first_number' WHEN n = b THEN 'order_duplicate' ELSE 'number_gap' END AS code FROM k WHERE (b IS NULL AND n <> 1) OR n = b OR n > b + 1""")
def numbering_findings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", (F.rint("s_acctbal").cast("long") % 6).alias("n"))
    return O.numbering(s, "s_nationkey", "n", "s_suppkey")


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS twin FROM conversations WHERE turn > 0""")
def renumbered_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("title"))
    out = O.renumbered(c, "conv_id", "turn", F.col("turn") > 0)
    return out.select("conv_id", "turn", F.col("number").cast("long").alias("number"), F.col("twin").cast("long").alias("twin"))


@query("""WITH k AS (SELECT conv_id, turn, turn // 3 AS unit FROM conversations), l AS (SELECT *, lag(unit) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM k) SELECT conv_id, turn, CASE WHEN b IS NULL OR b <> unit THEN unit * 100 ELSE turn END AS start FROM l""")
def unit_starts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("unit"))
    c = c.withColumns({"own": F.col("unit") * 100, "marker": F.col("turn").cast("long")})
    return O.group_starts(c, "conv_id", "unit", "turn", "own", "marker").select("conv_id", "turn", "start")


@query("""WITH d AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS n FROM lineitem WHERE l_partkey % 5 <> 0), f AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS n FROM lineitem WHERE l_partkey % 7 <> 0)
SELECT coalesce(d.g, f.g) AS book_id, count(*) FILTER (f.g IS NULL) AS only_declared, count(*) FILTER (d.g IS NULL) AS only_found FROM d FULL JOIN f ON d.g = f.g AND d.n = f.n GROUP BY 1 HAVING only_declared + only_found > 0""")
def asset_differences(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("book_id"), "l_linenumber", "l_partkey")
    return O.set_differences(li.where("l_partkey % 5 != 0"), li.where("l_partkey % 7 != 0"), "book_id", "l_linenumber")


@query("""SELECT CASE doc_id % 4 WHEN 0 THEN 'p' || doc_id WHEN 1 THEN 'p' || doc_id || '-subjective' WHEN 2 THEN 'b' || doc_id || '.s09' ELSE 'x' || doc_id END AS key,
  CASE doc_id % 4 WHEN 0 THEN 'p' || doc_id || '-analysis' WHEN 1 THEN 'p' || doc_id WHEN 2 THEN 'b' || doc_id || '.s10' END AS reference, CASE WHEN doc_id % 4 < 3 THEN n_chars END AS content FROM documents""")
def paired_references(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 4
    name = lambda a, b, c, e: F.when(kind == 0, F.concat(F.lit("p"), k, F.lit(a))).when(kind == 1, F.concat(F.lit("p"), k, F.lit(b))).when(kind == 2, F.concat(F.lit("b"), k, F.lit(c))).otherwise(F.concat(F.lit(e), k))
    return O.paired(d.select(name("", "-subjective", ".s09", "x").alias("key")), d.select(name("-analysis", "", ".s10", "y").alias("key"), F.col("n_chars").alias("content")))


@query("""WITH b AS (SELECT o_orderkey AS bank_id, CAST(year(CAST(o_orderdate AS DATE)) AS INT) AS year, CAST(o_orderkey % 2 + 1 AS INT) AS paper FROM orders)
SELECT bank_id, year, paper, CASE WHEN paper = 1 AND year % 2 = 0 THEN 'book-' || year WHEN year BETWEEN 1993 AND 1996 THEN 'aggregate' END AS book_id FROM b""")
def companion_books(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    banks = o.select(F.col("o_orderkey").alias("bank_id"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("paper"))
    books = banks.select("year", "paper").distinct().where("paper = 1 AND year % 2 = 0").withColumn("book_id", F.concat(F.lit("book-"), "year"))
    return O.companions(banks, books, "aggregate", 1993, 1996).select("bank_id", "year", "paper", "book_id")


@query("""WITH e AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN doc_id + 1 ELSE doc_id END AS fin FROM documents), p AS (SELECT doc_id AS id FROM documents WHERE doc_id % 7 <> 0) SELECT id FROM e WHERE fin NOT IN (SELECT id FROM p)""")
def id_drift(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    aliases = ids.where("id % 10 = 0").select(F.col("id").alias("legacy_id"), (F.col("id") + 1).alias("canonical_id"))
    return O.drifted(ids, ids.where("id % 7 != 0"), aliases)


@query("SELECT doc_id - doc_id % 5 AS canonical_id, string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS ids FROM (SELECT doc_id FROM documents UNION SELECT doc_id - doc_id % 5 FROM documents) GROUP BY 1")
def alias_sets(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    out = O.alias_sets(d.select(F.col("doc_id").alias("legacy_id"), (F.col("doc_id") - F.col("doc_id") % 5).alias("canonical_id")))
    return out.select("canonical_id", F.array_join(F.array_sort(F.col("ids").cast("array<string>")), ",").alias("ids"))


@query("""SELECT user_id % 20 AS page_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS ids FROM (SELECT user_id, event_type FROM events UNION ALL SELECT user_id + 1, event_type FROM events) GROUP BY 1""")
def knowledge_by_page(spark, sf_dir):
    u = F.col("user_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.array(u % 20, (u + 1) % 20).alias("pages"))
    return O.ids_by_page(e).select("page_id", F.array_join("ids", ",").alias("ids"))


@query("""WITH l AS (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE ' ' END AS label FROM documents), f AS (SELECT source, arg_min(label, doc_id) AS label FROM l WHERE trim(label) <> '' GROUP BY 1)
SELECT doc_id, coalesce(f.label, source) AS label FROM documents LEFT JOIN f USING (source)""")
def question_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    labels = d.select(F.col("source").alias("bank_id"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" ").alias("label"))
    return O.context_labels(d.select("doc_id", F.col("source").alias("bank_id"), F.lit(" ").alias("subject")), labels).select("doc_id", "label")


@query("""SELECT doc_id AS question_id, CASE WHEN doc_id % 6 = 0 THEN doc_id % 4 = 0 ELSE quality = 1 END AS resolved, CASE WHEN toxic = 1 THEN 'learning' ELSE 'unseen' END AS mastery FROM labels""")
def manual_resolve(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("resolved"), F.when(F.col("toxic") == 1, "text").alias("answer"))
    asked = table(spark, sf_dir, "documents").where("doc_id % 6 = 0").select(F.col("doc_id").alias("question_id"), (F.col("doc_id") % 4 == 0).alias("resolved"))
    return S.resolved_by_hand(a, asked).select("question_id", "resolved", S.mastery(F.lit("unseen"), F.col("answer"), F.lit(None).cast("string")).alias("mastery"))


@query("""WITH r AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, event_type AS subject_id FROM events), v AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'signup') > 0)
SELECT substring(sha256('review' || chr(9247) || date || chr(9247) || subject_id), 1, 16) AS activity_id, date, subject_id FROM r UNION ALL SELECT substring(sha256('vocab' || chr(9247) || date), 1, 16), date, 'vocab' FROM v""")
def derived_activities(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("date", F.to_date("ts"))
    days = e.groupBy("date").agg(F.collect_set("event_type").alias("subjects"), F.count_if(F.col("event_type") == "signup").alias("words_count"))
    out = S.review_activities(days).unionByName(S.vocab_activities(days))
    return out.select("activity_id", F.col("date").cast("string").alias("date"), "subject_id")


@query("""WITH e AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(user_id AS VARCHAR) AS item, floor(value) AS s, event_type FROM events), r AS (SELECT date, item, CAST(sum(s) AS BIGINT) AS s FROM e WHERE event_type = 'view' GROUP BY 1, 2 HAVING sum(s) > 0),
n AS (SELECT DISTINCT date, item FROM e WHERE event_type = 'signup'), d AS (SELECT DISTINCT date FROM e WHERE event_type = 'purchase')
SELECT substring(sha256(concat_ws(chr(9247), 'legacy', 'read', date, item)), 1, 16) AS activity_id, 'read' AS activity_type, s AS duration_seconds FROM r UNION ALL SELECT substring(sha256(concat_ws(chr(9247), 'legacy', 'notebook', date, item)), 1, 16), 'notebook', 0 FROM n
UNION ALL SELECT substring(sha256(concat_ws(chr(9247), 'legacy', 'review', date, 'day')), 1, 16), 'review', 0 FROM d""")
def legacy_backfill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("user_id").cast("string").alias("item"), F.floor("value").cast("long").alias("s"), "event_type")
    seconds = e.where("event_type = 'view'").groupBy("date", "item").agg(F.sum("s").alias("s")).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("item", "s"))).alias("section_seconds"))
    notes = e.groupBy("date").agg(F.collect_set(F.when(F.col("event_type") == "signup", F.col("item"))).alias("notes"), F.bool_or(F.col("event_type") == "purchase").alias("review_saved"))
    days = notes.join(seconds, "date", "left")
    none = spark.createDataFrame([], "activity_id string, date date, activity_type string, item_id string, duration_seconds long, result_state string")
    once = S.backfill(days, none)
    return S.backfill(days, once).select("activity_id", "activity_type", "duration_seconds")
