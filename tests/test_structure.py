"""Namespaces, JSON shapes and spans through marks on small fixtures."""

import json
import random
import re

from tidemark.operators import availability as A
from tidemark.operators import markup as M
from tidemark.operators import payloads as P

IDS = "{} string, domain string, knowledge_id string"


def test_availability(spark):
    books = spark.createDataFrame([("b1", "d", "p.m.ch01"), ("b1", "d", "p.m.ch01.s01"), ("b1", "d", "solo"), ("b2", "e", "p.m.ch01"), ("b3", "d", None)], IDS.format("book_id"))
    questions = spark.createDataFrame([("q", i, k) for i, k in enumerate(["p.m.ch01.s01", "p.m.ch01.s02.t1", "p.m.ch02", "x.y.ch01", "solo", None])] + [("q", 0, "p.m.ch01.s01")], "bank_id string, question_id long, knowledge_id string")
    banks = spark.createDataFrame([("q", "d", "p.m.ch01.s01"), ("q", "d", "x.y.ch01"), ("r", "e", "x.y"), ("r", "d", "solo")], IDS.format("bank_id"))
    counts = A.question_counts(questions)
    assert [tuple(r) for r in A.namespace_overlap(books, banks).collect()] == [("b1", "q")]
    assert [tuple(r) for r in A.book_availability(books, banks, counts).collect()] == [("b1", "q", "p.m", "comprehensive", 3)]
    sections = spark.createDataFrame(
        [("s1", "b1", 0, "p.m.ch01"), ("s1", "b1", 1, "p.m.ch01.s01"), ("s1", "b1", 2, "p.m.ch01.s02.t1"), ("s2", "b1", 0, "p.m.ch01.s09"), ("s2", "b1", 1, "p.m.ch02"), ("s3", "b2", 0, "p.m.ch01.s01"), ("s4", "b1", 0, "solo")],
        "section_id string, book_id string, place int, knowledge_id string",
    )
    got = sorted(tuple(r) for r in A.section_availability(sections, books, banks, counts).collect())
    assert got == [("s1", "q", "p.m.ch01.s02.t1", "section", 1), ("s2", "q", "p.m.ch01", "chapter", 2), ("s2", "q", "p.m.ch02", "chapter", 1)]
    assert A.book_availability(books.limit(0), banks, counts).count() == 0 and A.section_availability(sections.limit(0), books, banks, counts).count() == 0


def test_one_hot_namespace(spark):
    books = spark.createDataFrame([(f"b{i}", "d", f"h.h.ch0{j}") for i in range(40) for j in range(5)], IDS.format("book_id"))
    banks = spark.createDataFrame([(f"q{i}", "d", f"h.h.ch0{j}") for i in range(30) for j in range(5)], IDS.format("bank_id"))
    assert A.namespace_overlap(books, banks).count() == 1200


def test_canonical_json(spark):
    values = [{"b": {"z": [1, None, {"y": "é", "x": True}], "a": -3}, "B": "\n\"", "": {}}, [], [{"b": 1, "a": []}], "text", 7, None]
    rows = [(i, json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3)) for i, v in enumerate(values)] + [(90, "no json"), (91, '{"a":1,"a":2}'), (92, None), (93, "")]
    got = {r["i"]: r["c"] for r in spark.createDataFrame(rows, "i int, j string").select("i", P.canonical(P.F.col("j")).alias("c")).collect()}
    want = {i: json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for i, v in enumerate(values)} | {90: None, 91: None, 92: None, 93: None}
    assert got == want


def test_shapes(spark):
    rows = spark.createDataFrame([('{"a":[1,[2],null],"o":{"k":{"deep":1}},"n":1.5}',), ('{"a":"s","o":{}}',), ("[]",), ("bad",), (None,), ('{"x":1,"x":1}',)], "j string")
    got = {(r["path"], r["kind"]): (r["n"], r["longest"]) for r in P.shapes(rows, "j").collect()}
    assert got == {
        ("$", "object"): (2, None), ("$", "array"): (1, 0), ("$", "invalid"): (2, None), ("$.a", "array"): (1, 3), ("$.a", "string"): (1, None), ("$.a[]", "number"): (1, None), ("$.a[]", "array"): (1, 1),
        ("$.a[]", "null"): (1, None), ("$.o", "object"): (2, None), ("$.o.k", "object"): (1, None), ("$.n", "number"): (1, None),
    }
    assert P.shapes(rows.limit(0), "j").count() == 0


def test_depth_against_a_plain_walk(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choices(["<t>", "</t>", "<T class='x'>", "</t >", "x", "<tr>", "< t>", "é", "<t"], k=rng.randint(0, 30)))) for i in range(40)] + [(90, None), (91, "")]
    spans = [(i, *sorted((rng.randint(0, len(x or "")), rng.randint(0, len(x or ""))))) for i, x in docs for _ in range(3)]
    got = {tuple(r)[:3]: (len(re.findall("<t>", r["prefix"])), len(re.findall("</t>", r["suffix"])), r["last_open"]) for r in M.span_wrappers(spark.createDataFrame(docs, "id long, text string"), "id", "text", spark.createDataFrame(spans, "id long, start long, end long").distinct(), "t").collect()}
    texts = dict(docs)

    def depth(text, at):
        level = 0
        for m in re.finditer(r"(?i)</?t(?=[\s/>])[^>]*>", text or ""):
            if m.start() < at:
                level = max(0, level + (-1 if m[0].startswith("</") else 1))
        return level

    opens = lambda text, at: max((m.start() for m in re.finditer(r"(?i)<t(?=[\s/>])[^>]*>", text or "") if m.start() <= at - 1), default=None)
    assert got == {(i, a, b): (depth(texts[i], a), depth(texts[i], b), opens(texts[i], a)) for i, a, b in spans}


def test_spans_through_a_table(spark):
    text = "head <table><tr><td>1</td></tr><tr><td>2</td></tr></table> tail"
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    cut = text.index("<tr><td>2")
    spans = spark.createDataFrame([(1, 5, cut), (1, cut, len(text)), (1, 0, 5)], "id long, start long, end long")
    got = {r["start"]: (r["prefix"], r["suffix"], r["last_open"]) for r in M.span_wrappers(docs, "id", "text", spans, "table").collect()}
    assert got == {5: ("", "</table>", None), cut: ("<table>", "", 5), 0: ("", "", None)}
    places = spark.createDataFrame([(1, 0, text.index("1<")), (1, 0, text.index("2<")), (1, 6, text.index("2<")), (1, 0, 3)], "id long, line_start long, at long")
    got = {(r["line_start"], r["at"]): r["start"] for r in M.span_starts(docs, "id", "text", places, "table", "tr").collect()}
    assert got == {(0, text.index("1<")): 5, (0, text.index("2<")): cut, (6, text.index("2<")): 6, (0, 3): 0}
