"""Small cases with hand-made rows: edges, ties, nulls, and streams against batches."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

D = dt.date


def activity(day, kind, seconds, state="in_progress", refs=(), resource="r", item="i", domain="medicine", n=[0]):
    n[0] += 1
    return (n[0], D(2026, 1, day), f"a{n[0]}", kind, domain, resource, item, seconds, dt.datetime(2026, 1, day, 9, n[0] % 60), state, list(refs))


SCHEMA = "ord long, date date, activity_id string, activity_type string, domain string, resource_id string, item_id string, duration_seconds long, last_active_at timestamp_ntz, result_state string, output_refs array<string>"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_coalescing_keeps_the_highest_state_and_sums(spark):
    from tidemark.operators.activity import coalesced

    rows = frame(spark, activity(1, "read", 40, domain="english"), activity(1, "read", 40, "completed", domain="politics"), activity(1, "read", -5, "completed", ["x"]), activity(1, "read", 7, resource=None), activity(1, "read", 7, resource=None))
    got = coalesced(rows).orderBy("ord").collect()
    assert [(r["duration_seconds"], r["merged"]) for r in got] == [(80, 3), (7, 1), (7, 1)]
    assert (got[0]["result_state"], got[0]["domain"], got[0]["output_refs"]) == ("completed", "politics", ["x"])


def test_meaningful_and_streak(spark):
    from tidemark.operators.activity import meaningful_days
    from tidemark.operators.calendar import streak

    rows = frame(spark, activity(1, "read", 60), activity(2, "read", 59), activity(3, "notebook", 0, "completed"), activity(4, "read", 30), activity(4, "read", 31), activity(5, "review", 900), activity(7, "read", 90))
    days = meaningful_days(rows)
    assert sorted(r["date"].day for r in days.collect()) == [1, 3, 4, 7]
    at = lambda d: spark.createDataFrame([(D(2026, 1, d),)], "as_of date")
    assert [streak(days, at(d)).first()["streak"] for d in (4, 5, 6, 7, 1)] == [2, 2, 0, 1, 1]


def test_empty_activities(spark):
    from tidemark.operators import activity as A

    none = frame(spark)
    assert A.golden_slot(none).first().asDict() == {"slot": "evening", "slot_seconds": 0, "percent": 0}
    assert A.input_output_ratio(none).first()["input_percent"] == 0
    assert A.subject_balance(none).first().asDict() == {"medicine": 0, "politics": 0, "english": 0, "score": 50}
    assert A.continue_target(none).count() == 0
    assert {r["records"] for r in A.zero_filled(A.totals(none, "activity_type"), "activity_type", A.TYPES).collect()} == {0}


def test_weeks(spark):
    from tidemark.operators.calendar import iso_week, week_bounds

    days = spark.createDataFrame([(D(2027, 1, 1),), (D(2024, 12, 30),)], "d date").select(iso_week("d").alias("w"))
    assert [r["w"] for r in days.collect()] == ["2026-W53", "2025-W01"]
    a, b = week_bounds(F.col("w"))
    got = spark.createDataFrame([("2026-W53",), ("2025-W53",), ("2026-W01",)], "w string").select(a.alias("a"), b.alias("b")).collect()
    assert [tuple(r) for r in got] == [(D(2026, 12, 28), D(2027, 1, 3)), (None, None), (D(2025, 12, 29), D(2026, 1, 4))]


def test_aliases_of_any_length(spark):
    from tidemark.operators.lineage import alias_closure

    n = 300
    chain = [(f"c{i}", f"c{i + 1}") for i in range(n)]
    cycles = [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("p", "q"), ("q", "p"), ("lost", "unknown")]
    got = alias_closure(spark.createDataFrame(chain + cycles, "legacy_id string, current_id string"), spark.createDataFrame([(f"c{n}",), ("x",), ("p",)], "id string"))
    assert dict(tuple(r) for r in got.collect()) == {a: f"c{n}" for a, _ in chain} | {a: None for a, _ in cycles}
    none = spark.createDataFrame([], "legacy_id string, current_id string")
    assert alias_closure(none, spark.createDataFrame([], "id string")).count() == 0


def test_aliases(spark):
    from tidemark.operators.lineage import alias_closure

    edges = spark.createDataFrame([("b", "a"), ("c", "d"), ("e", "f"), ("f", "e"), ("g", "b"), ("h", "e")] + [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", "a")], "legacy_id string, current_id string")
    got = dict(tuple(r) for r in alias_closure(edges, spark.createDataFrame([("a",)], "id string")).collect())
    assert got["b"] == got["g"] == got["n0"] == "a" and got["c"] is got["e"] is got["f"] is got["h"] is None


def test_intervals_and_as_of(spark):
    from tidemark.operators.lineage import as_of, coverage, number_gaps

    rows = spark.createDataFrame([("x", 1, 10), ("x", 11, 20), ("x", 15, 16), ("x", 22, 30), ("x", 30, 31)], "g string, start long, stop long")
    assert sorted((r["start"], r["finding"]) for r in coverage(rows, "g").collect()) == [(15, "overlap"), (22, "gap"), (30, "overlap")]
    left, right = spark.createDataFrame([("x", 1), ("x", 5), ("x", 9)], "g string, t long"), spark.createDataFrame([("x", 5, "a"), ("x", 8, "b")], "g string, t long, v string")
    assert sorted((r["t"], r["v"]) for r in as_of(left, right, "g", "t", "v").collect() if r["v"]) == [(5, "a"), (9, "b")]
    assert [tuple(r) for r in number_gaps(spark.createDataFrame([("p", 1), ("p", 2), ("p", 4)], "p string, n int"), "p", "n").collect()] == [("p", 4, 3)]


def test_mistakes_and_due(spark):
    from tidemark.operators import practice as P
    from tidemark.operators import recall as R

    a = spark.createDataFrame([(1, True, None), (2, False, None), (3, None, None), (4, True, True), (5, None, True)], "question_id long, correct boolean, previously_wrong boolean")
    assert [r["question_id"] for r in a.where(P.is_mistake()).orderBy("question_id").collect()] == [2, 4, 5]
    assert tuple(P.mistake_totals(a).first()) == (3, 2, 1, 33)
    now = dt.datetime(2026, 1, 1, 12)
    rows = [("u", "unseen", None), ("m", "mastered", now), ("l", "learning", now + dt.timedelta(hours=2)), ("f", "fuzzy", now + dt.timedelta(hours=3)), ("n", "mastered", None), ("z", "mastered", now + dt.timedelta(minutes=1))]
    due = R.due(spark.createDataFrame(rows, "item_id string, mastery string, next_review_at timestamp_ntz"), F.lit(now).cast("timestamp_ntz"), 9)
    assert [r["item_id"] for r in due.collect()] == ["l", "n", "m"]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_join_again(seed):
    from tidemark.operators.documents import chunk

    rng = random.Random(seed)
    text = "".join(rng.choices(["word", " ", ". ", "\n", "\n\n", "。", "x" * 30], k=400))
    parts = chunk(text, 50)
    assert "".join(parts) == text and max(map(len, parts)) <= 50
    assert chunk("", 5) == [""]


def test_text_functions(spark):
    from tidemark.functions import text as X

    one = lambda s, f: spark.createDataFrame([(s,)], "s string").select(f(F.col("s")).alias("x")).first()["x"]
    assert [one(s, X.is_blank) for s in ("　 \n", "", None, " a")] == [True, True, True, False]
    assert [one(s, X.numeral) for s in ("十", "二十三", "一百零三", "abc", "")] == [10, 23, 103, None, None]
    assert one("体验支托", lambda c: X.guarded_replace(c, [("验", "𬌗")], ["体验"])) == "体验支托"
    assert one("验面 检验", lambda c: X.guarded_replace(c, [("验", "𬌗")], ["检验"])) == "𬌗面 检验"
    assert [one(n, lambda c: X.duration(c.cast("long"))) for n in ("59", "60", "125")] == ["59秒", "1分钟", "2分5秒"]
    assert [one(s, X.safe_name) for s in ("a/b: c", "   ", None)] == ["a-b- c", "untitled", "untitled"]


def test_findings_block_a_whole_package(spark):
    from tidemark.operators.findings import Rule, admitted, rollup, row_findings

    rows = spark.createDataFrame([("1", "p", None), ("2", "p", "x"), ("3", "q", "y")], "id string, package string, stem string")
    found = row_findings(rows, [Rule("E016", F.col("stem").isNull()), Rule("W001", F.col("stem") == "y")], "id")
    assert sorted(tuple(r) for r in found.collect()) == [("1", "blocker", "E016"), ("3", "warning", "W001")]
    assert [r["id"] for r in admitted(rows, found, "package", "id").collect()] == ["3"]
    assert rollup(found).first()["status"] == "blocked"


def test_heartbeat_stream_gives_the_batch(spark, tmp_path):
    from tidemark.streaming import heartbeats as H

    rng = random.Random(1)
    start = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(start + dt.timedelta(minutes=7 * i), f"r{i % 3}", f"k{rng.randint(0, 60)}", rng.choice([0, 5, 600, 601])) for i in range(200)]
    batch = spark.createDataFrame(rows, "ts timestamp, resource string, key string, seconds long")
    batch.repartition(3).write.parquet(f"{tmp_path}/in")
    want = H.once(H.valid(batch)).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("k"))
    stream = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    out = H.once(H.valid(stream), "3 days").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    out.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("k"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_most_specific_and_runs(spark):
    from tidemark.operators import practice as P

    sections = spark.createDataFrame([("s1", ["a.b", "a.b.c"], "a"), ("s2", ["z"], "a"), ("s3", ["z"], "y")], "section_id string, knowledge_ids array<string>, chapter_id string")
    questions = spark.createDataFrame([(1, "a.b"), (2, "a.b.c"), (3, "a")], "question_id long, knowledge_id string")
    assert sorted((r["section_id"], r["knowledge_id"], r["level"]) for r in P.most_specific(sections, questions).collect()) == [("s1", "a.b.c", 0), ("s2", "a", 1)]
    turns = spark.createDataFrame([("c", 1, "u", "t"), ("c", 2, "u", None), ("c", 3, None, "t"), ("c", 4, None, "t"), ("c", 5, "u", "t")], "g string, n long, role string, text string")
    assert [r["rows"] for r in P.runs(turns, "g", "n", "role").orderBy("run").collect()] == [2, 2, 1]


def rows_made(df):
    """Most rows that any step of df made, and its rows."""
    spark, found = df.sparkSession, []
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        rows, steps = df.collect(), [df._jdf.queryExecution().executedPlan()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    while steps:
        step = steps.pop()
        made = step.metrics().get("numOutputRows")
        found.append(made.get().value() if made.isDefined() else 0)
        steps += [step.children().apply(i) for i in range(step.children().size())]
    return max(found), rows


def test_most_specific_counts_before_it_joins(spark):
    from tidemark.operators.practice import most_specific

    sections = spark.range(300).select(F.col("id").alias("section_id"), F.expr("IF(id = 7, array('k', 'k.1', null), array('x'))").alias("knowledge_ids"), F.lit("c").alias("chapter_id"))
    questions = spark.range(200).select(F.col("id").alias("question_id"), F.lit("c").alias("knowledge_id")).unionByName(spark.createDataFrame([(1, "k"), (1, "k.1"), (1, "k.1"), (None, "k.1"), (2, None)], "question_id long, knowledge_id string"))
    most, rows = rows_made(most_specific(sections, questions))
    want = {i: (i, "c", 200, 1) for i in range(300)} | {7: (7, "k.1", 1, 0)}
    assert {r["section_id"]: tuple(r) for r in rows} == want and len(rows) == 300
    assert most < 2000


def test_trees_of_any_depth(spark):
    from tidemark.operators.lineage import breadcrumbs, cyclic_nodes, missing_parents

    chain = [(i, i - 1 if i else None, f"t{i}") for i in range(300)]
    rows = [*chain, (1000, 1001, "a"), (1001, 1000, "b"), (1002, 1000, "under"), (2000, 2001, "lost"), (2002, 2000, "below")]
    nodes = spark.createDataFrame(rows, "id long, parent_id long, title string")
    got = {r["id"]: (r["path"], r["depth"], r["root"]) for r in breadcrumbs(spark, nodes).collect()}
    assert got == {i: (" / ".join(f"t{j}" for j in range(i + 1)), i + 1, 0) for i in range(300)}
    assert sorted(r["id"] for r in cyclic_nodes(nodes.select("id", "parent_id")).collect()) == [1000, 1001, 1002]
    assert [r["id"] for r in missing_parents(nodes).collect()] == [2000]


def test_activity_filter_rejects_unknown_values(spark):
    import pytest

    from tidemark.operators.listing import filtered_activities

    df = spark.createDataFrame([("2024-01-02", "read", ["k"]), ("2024-01-03", "review", [])], "date string, activity_type string, idempotency_keys array<string>").withColumn("date", F.col("date").cast("date"))
    got = filtered_activities(df, "2024-01-02", "read")
    assert got.columns == ["date", "activity_type"] and got.count() == 1
    for bad in ({"day": "2024-13-01"}, {"kind": "sleep"}):
        with pytest.raises(ValueError):
            filtered_activities(df, **bad)


def test_pages_stream_and_places_by_ranges(spark):
    from tidemark.operators import documents as D
    from tidemark.operators import summary as S

    data = [(g, i, (i * 37 + len(g)) % 900 + (6000 if i == 50 else 0)) for g in ("a", "bb") for i in range(200)]
    rows = spark.createDataFrame(data, "g string, i int, n int")
    want = []
    for g in ("a", "bb"):
        page, used = 1, 0
        for _, i, n in (r for r in data if r[0] == g):
            if used and used + n + 80 > 5000:
                page, used = page + 1, 0
            used += n + 80
            want.append((g, i, page))
    assert sorted((r["g"], r["i"], r["page"]) for r in D.pages(rows, "g", "i", "n", 5000).collect()) == want
    assert D.pages(rows.limit(0), "g", "i", "n", 5000).count() == 0
    order = (F.desc("n"), F.col("g"), F.col("i"))
    got = [(r["g"], r["i"]) for r in S.numbered(rows, "place", *order).orderBy("place").collect()]
    assert got == [(g, i) for g, i, _ in sorted(data, key=lambda r: (-r[2], r[0], r[1]))]
    assert [r["place"] for r in S.page(rows, 999, 30, *order).orderBy("place").collect()] == list(range(391, 401))


def test_answers_with_one_place_go_wrong_first(spark):
    from tidemark.operators.recall import answer_states

    rows = [(1, 5, True), (1, 5, None), (1, 5, False), (1, None, True), (2, 5, True), (2, 5, False), (2, 4, True)]
    for answers in (rows, rows[::-1]):
        got = answer_states(spark.createDataFrame(answers, "question_id long, ord long, correct boolean").coalesce(1)).collect()
        assert {tuple(r) for r in got} == {(1, 5, False, False, False), (1, 5, True, True, True), (1, 5, None, True, None), (1, None, True, True, True), (2, 4, True, False, False), (2, 5, False, False, False), (2, 5, True, True, True)}


def test_numbers_of_halves(spark, tmp_path):
    """Halves go to the even number, as in the SQL; suppliers without a number come last."""
    import duckdb

    from tidemark.plans.registry import ORACLES, QUERIES

    rows = [(1, 1, 0.5), (2, 1, 1.0), (3, 1, 2.5), (4, 1, None), (5, 2, 1.5), (6, 2, 3.5), (7, 2, -0.5), (8, 2, -2.5)]
    path = f"{tmp_path}/supplier.parquet"
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}/*.parquet'")
    got = QUERIES["numbering_findings"](spark, str(tmp_path)).select("s_nationkey", "s_suppkey", "code").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"SELECT s_nationkey, s_suppkey, code FROM ({ORACLES['numbering_findings']})").fetchall())


def test_names_are_met_in_tasks_of_so_many_rows(spark, monkeypatch):
    from tidemark.operators import outline as O

    monkeypatch.setattr(O, "ROWS_PER_TASK", 20)
    declared = spark.range(300).selectExpr("id % 7 AS book", "id % 50 AS name")
    got = O.set_differences(declared, declared.where("name % 3 != 0").unionByName(spark.createDataFrame([(3, 99), (3, 99), (9, None)], "book long, name long")), "book", "name")
    assert re.search(r"hashpartitioning\(book#\d+L, name#\d+L, 26\)", got._jdf.queryExecution().executedPlan().toString())  # 501 rows
    assert {tuple(r) for r in got.collect()} == {(b, len({i % 50 for i in range(300) if i % 7 == b and i % 50 % 3 == 0}), int(b == 3)) for b in range(7)} | {(9, 0, 1)}


def test_trees_are_merged_and_not_broadcast(spark, tmp_path):
    from tidemark.operators.lineage import cyclic_nodes, missing_parents

    spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 9), (6, 5)], "id long, parent_id long").write.parquet(f"{tmp_path}/nodes")
    nodes = spark.read.parquet(f"{tmp_path}/nodes")
    for found, ids in ((cyclic_nodes(nodes), {3, 4}), (missing_parents(nodes), {5})):
        assert {r["id"] for r in found.collect()} == ids
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
