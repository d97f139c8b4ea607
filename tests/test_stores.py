"""Stores and sinks over small files."""

import json

import pytest
from pyspark.sql import functions as F


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_questions_and_activities(spark, tmp_path):
    from tidemark.sources import stores

    lines = [{"question_id": "q1", "status": "ready", "options": [{"label": "A", "text_md": "x"}]}, {"question_id": "q2", "status": "draft"}, {"status": "ready"}]
    path = put(tmp_path / "q.jsonl", "\n".join(map(json.dumps, lines)))
    assert [r["question_id"] for r in stores.questions(spark, path).collect()] == ["q1"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        stores.questions(spark, put(tmp_path / "bad.jsonl", '{"question_id": ')).collect()
    store = {"days": {"2026-01-02": {"activities": [{"activity_id": "a", "duration_seconds": -4}, {"activity_id": "b", "duration_seconds": 7, "output_refs": [{"kind": "k", "id": "1"}]}]}, "other": {"activities": [{"activity_id": "c"}]}}}
    got = stores.activities(spark, put(tmp_path / "a.json", store)).orderBy("ord").collect()
    assert [(r["activity_id"], r["duration_seconds"]) for r in got] == [("a", 0), ("b", 7)]


def test_keyed_and_missing(spark, tmp_path):
    from tidemark.sources import stores

    path = put(tmp_path / "k.json", {"items": {"x": {"correct": True}, "y": {"correct": None}}})
    assert sorted(tuple(r) for r in stores.keyed(spark, path, "correct boolean, answered_at string").collect()) == [("x", True, None), ("y", None, None)]
    assert stores.keyed(spark, str(tmp_path / "none.json"), "correct boolean").count() == 0


def test_recall_items(spark, tmp_path):
    from tidemark.sources import stores

    data = {"subjects": [{"id": "s", "chapters": [{"id": "c", "order": 1, "items": [{"id": "1", "type": "definition"}, {"id": "2"}]}]}]}
    assert [(r["subject_id"], r["chapter_id"], r["id"]) for r in stores.recall_items(spark, put(tmp_path / "r.json", data)).orderBy("id").collect()] == [("s", "c", "1"), ("s", "c", "2")]
    data["subjects"][0]["chapters"][0]["items"][1]["id"] = "1"
    with pytest.raises(Exception, match="repeated id"):
        stores.recall_items(spark, put(tmp_path / "r2.json", data)).collect()


def test_books_notes_and_settings(spark, tmp_path):
    from tidemark.sources import stores

    good = {"schema_version": 2, "book": {"id": "book-a", "title": "T", "domain": "english", "subject": " "}, "status": "ready", "toc": [{"id": "c1", "title": "One", "order": 1, "section_ids": ["s2", "zz", "s1"]}, {"id": "c2", "title": "Two", "order": 2, "section_ids": ["zz"]}]}
    put(tmp_path / "books/a/manifest.json", good)
    put(tmp_path / "books/b/manifest.json", good | {"quality": {"blocker_count": 1}})
    books = stores.books(spark, f"{tmp_path}/books")
    assert [(r["id"], r["subject"]) for r in books.collect()] == [("book-a", "T")]
    toc = stores.toc(books, spark.createDataFrame([("book-a", "s1"), ("book-a", "s2")], "book_id string, section_id string"))
    assert sorted((r["chapter_id"], r["section_order"], r["section_id"]) for r in toc.collect()) == [("c1", 0, "s2"), ("c1", 2, "s1")]
    put(tmp_path / "notes/one.md", "﻿# 标题\n")
    put(tmp_path / "notes/sub/two.md", "　\n ")
    assert [(r["key"], r["markdown"]) for r in stores.notes(spark, f"{tmp_path}/notes").collect()] == [("one", "# 标题")]
    limits = {"hours": (1, 16)}
    assert stores.settings(spark, put(tmp_path / "g.json", {"hours": 99}), {"hours": 8, "words": 50}, limits).first().asDict() == {"hours": 16.0, "words": 50.0}
    assert stores.settings(spark, str(tmp_path / "none.json"), {"hours": 8}, limits).first()["hours"] == 8.0
    before = stores.signature(spark, f"{tmp_path}/notes").first()
    put(tmp_path / "notes/three.md", "x")
    after = stores.signature(spark, f"{tmp_path}/notes").first()
    assert (before["files"], after["files"]) == (2, 3) and before["signature"] != after["signature"]


def test_preferred(spark):
    from tidemark.sources.stores import preferred

    rows = spark.createDataFrame([("d", 1, "local"), ("d", 0, "vault"), ("e", 1, "local")], "key string, priority int, body string")
    assert sorted(r["body"] for r in preferred(rows, "key", F.asc("priority")).collect()) == ["local", "vault"]


def test_sinks(spark, tmp_path):
    from tidemark.sources import sinks

    rows = spark.createDataFrame([("a/b", 2, "second"), ("a/b", 1, "first"), ("c", 1, None)], "subject string, n int, body string")
    got = {r["name"]: r["value"] for r in sinks.notes(rows, "subject", "n", F.coalesce("body", F.lit(""))).collect()}
    assert got == {"a-b": "# a/b\n\nfirst\n\nsecond\n", "c": "# c\n\n\n"}
    sinks.write_notes(sinks.notes(rows, "subject", "n", F.coalesce("body", F.lit(""))), f"{tmp_path}/notes")
    assert spark.read.option("wholetext", True).text(f"{tmp_path}/notes").where("name = 'a-b'").first()["value"].startswith("# a/b")
    sinks.write_lines(rows.where("subject = 'c'"), f"{tmp_path}/lines")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/lines").collect()] == ['{"subject":"c","n":1}']
    assert sinks.publish(rows, f"{tmp_path}/bank", "v1", F.col("n") > 0) == 3
    sinks.publish(rows.where("n = 1"), f"{tmp_path}/bank", "v2", F.col("n") > 0)
    assert sinks.current(spark, f"{tmp_path}/bank").count() == 2
    with pytest.raises(ValueError, match="published"):
        sinks.publish(rows, f"{tmp_path}/bank", "v3", F.col("n") > 1)
