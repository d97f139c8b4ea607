"""The pipeline on the smallest tables: what each stage keeps, by the brute-force versions of the operator tests."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_against_brute_force import removed

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "bpe_encoding":
            assert out.columns == columns and out.schema == docs.schema
        seen[name] = (docs, out)
        docs = out
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in seen["substring_dedup"])
    cut = removed(before)
    assert set(after) == {k for k, (n, gone, _) in cut.items() if not gone or n > gone}
    assert all(after[k] == before[k] for k in after if not cut[k][1])
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1")
    gone = seen["toxicity"][0].join(seen["toxicity"][1], "doc_id", "left_anti")
    assert gone.join(toxic, "doc_id").count() > 0.6 * toxic.count()
    before, after = seen["ngram_jaccard_join"]
    assert before.groupBy(F.trim("text")).count().count() >= after.count() == after.select("text").distinct().count()
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in docs.collect())
