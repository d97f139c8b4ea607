"""Outlines by tiers, repaired headings, carving, attached ids, signatures and chunks of pages on small fixtures."""

from tidemark.operators import chapters as C


def guide(spark, text, title="Own title"):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"), 1)], "doc long, line_no long, line string")
    got = C.section_guides(rows, spark.createDataFrame([(1, title)], "doc long, title string"), "doc")
    return [(r["line_no"], r["level"], r["title"], r["tier"]) for r in got.orderBy("line_no").collect()]


def test_section_guides(spark):
    assert guide(spark, "## 考点 1 a\n# 一、x\n## 考点2 b\n## 考点 1 A #\n# 二、y") == [(1, 2, "考点 1 a", "point"), (3, 2, "考点2 b", "point")]
    assert guide(spark, "## 考点 1 a\n# 一、x\n### 二．y") == [(2, 1, "一、x", "major"), (3, 3, "二．y", "major")]
    assert guide(spark, "### deep\n## one\n## One！\n## two\n") == [(2, 2, "one", "level"), (4, 2, "two", "level")]
    assert guide(spark, "## lost\n# own *title*\n## a\n```\n## code\n```\n## b\n# 第三章 x\n# 导言") == [(3, 2, "a", "level"), (7, 2, "b", "level")]
    assert guide(spark, "## only one\ntext") == [] and guide(spark, "") == []
    assert guide(spark, "## ...\n## b\n## c", None) == [(2, 2, "b", "level"), (3, 2, "c", "level")]


def test_section_guides_reads_lines_once(spark):
    rows = spark.range(77).selectExpr("IF(id < 70, id DIV 7, NULL) AS doc", "id % 7 + 1 AS line_no", "array('## lost', '# Own', '## a', '```', '## code', '```', concat('## b', id))[id % 7] AS line")
    titles = spark.range(10).selectExpr("id AS doc", "IF(id % 2 = 0, 'own', NULL) AS title")
    got = C.section_guides(rows, titles.unionByName(titles.where("doc = 0")), "doc")
    want = {(d, n, x) for d in range(10) for n, x in ([(2, "Own")] if d % 2 else [(3, "a"), (7, f"b{7 * d + 6}")])}
    assert {(r["doc"], r["line_no"], r["title"]) for r in got.collect()} == want and got.count() == len(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 77,") == 1


def test_heading_repairs(spark):
    text = ["## 第", "", "## 段原文", "x", "## 第1段原文", "## 段原文", "##第 3 段原文", "## 第4段原文", "## 第", "y", "## 段原文"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(text, 1)] + [(2, 1, "## 第"), (2, 2, None)], "page long, line_no long, line string")
    got = sorted((r["line_no"], r["new"]) for r in C.heading_repairs(rows, "page", "## 第", "## 段原文").collect())
    assert got == [(1, "## 第1段原文"), (3, ""), (5, "## 第2段原文"), (6, "## 第3段原文"), (7, "## 第4段原文"), (8, "## 第5段原文"), (11, "## 第6段原文")]


def test_carved(spark):
    pages = spark.createDataFrame([("b", 1, 10, "reading"), ("b", 11, 20, "reading"), ("c", 1, 5, "x")], "book string, start long, end long, role string")
    cuts = spark.createDataFrame([("b", 1, 3), ("b", 20, 20), ("c", 9, 9)], "book string, cut_start long, cut_end long")
    got = sorted((r["book"], r["order"], r["start"], r["end"], r["role"]) for r in C.carved(pages, cuts, "book").collect())
    assert got == [("b", 1, 1, 3, "reference"), ("b", 2, 4, 10, "reading"), ("b", 3, 11, 19, "reading"), ("b", 4, 20, 20, "reference"), ("c", 1, 1, 5, "x")]


def test_attached_ids(spark):
    entries = spark.createDataFrame([(2, "z", ["p", "q"]), (1, "y", ["q", "q"]), (3, "z", ["q"]), (4, "n", None)], "place long, id string, page_ids array<string>")
    got = {r["section_id"]: r["knowledge_ids"] for r in C.attached_ids(entries, spark.createDataFrame([("p",), ("q",), ("r",)], "section_id string")).collect()}
    assert got == {"p": ["z"], "q": ["y", "y", "z", "z"], "r": []}


def test_signature(spark):
    rows = [(f"f{i}", i, None if i % 5 else i) for i in range(300)]
    df = spark.createDataFrame(rows, "path string, size long, time long")
    of = lambda d: tuple(C.signature(d, ["path", "size", "time"]).first())
    assert of(df) == of(df.orderBy("size").repartition(7)) and of(df)[1] == 300
    assert of(df) != of(df.limit(299)) and of(df)[0] != of(spark.createDataFrame([*rows[:-1], ("f299", 299, 1)], df.schema))[0]
    assert of(df.limit(0))[1] == 0


def test_chunks(spark, tmp_path):
    for name, text in {"good/pages-0-3": "﻿one\r\n\n", "good/pages-4-4": "two", "gap/pages-0-1": "a", "gap/pages-3-4": "b", "twin/pages-0-1": "a", "late/pages-1-2": "a", "late/pages-2-1": "b"}.items():
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "out.md").write_text(text, encoding="utf-8")
    (tmp_path / "twin/pages-0-1/sub").mkdir()
    (tmp_path / "twin/pages-0-1/sub/more.md").write_text("again")
    (tmp_path / "good/readme.md").write_text("no chunk")
    chunks = C.chunk_files(spark, str(tmp_path))
    totals = spark.createDataFrame([("good", 5), ("gap", 5), ("twin", 3), ("late", 3), ("none", 2)], "book string, pages long")
    findings = C.chunk_findings(chunks, totals)
    assert sorted((r["book"], r["first"] if r["first"] is not None else -1, r["code"]) for r in findings.collect()) == [
        ("gap", 3, "range_gap"), ("late", 1, "range_gap"), ("late", 2, "range_backwards"), ("late", 2, "range_overlap"), ("none", -1, "page_total"), ("twin", -1, "page_total"), ("twin", 0, "chunk_twin"),
    ]
    got = [tuple(r) for r in C.assembled(chunks, findings).orderBy("place").collect()]
    assert got == [("good", 1, "<!-- source-pdf-pages: 1-4 -->\n\none", 0), ("good", 2, "<!-- source-pdf-pages: 5-5 -->\n\ntwo", 37)]
    assets = spark.createDataFrame([("good", "a.png", "1"), ("good", "a.png", "1"), ("good", "b.png", "1"), ("good", "b.png", "2"), ("gap", "b.png", "3")], "book string, name string, sha256 string")
    assert [tuple(r) for r in C.name_clashes(assets).collect()] == [("good", "b.png", 2)]
