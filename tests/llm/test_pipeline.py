"""The pipeline stage by stage on the smallest tables, and on rows with odd values."""

from __future__ import annotations

import corpus_pipeline as P
from tidepanel.llm import decontaminate, simhash

DATA = "/root/testdata/sf0.001"


def test_stages_in_order_and_each_works_on_its_input(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    whole = docs.count()
    for name, stage in P.STAGES[:-1]:
        out = P.materialise(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        assert 0.5 * docs.count() < out.count() <= docs.count()
        if name == "simhash_near_dedup":
            assert simhash.simhash_classes(docs).select("component_id").distinct().count() == out.count()
            assert simhash.simhash_classes(out).groupBy("component_id").count().filter("count > 1").count() == 0
        if name == "decontamination":
            assert decontaminate.leaks(out, spark.read.parquet(f"{DATA}/benchmark.parquet")).count() == 0
        if name == "line_dedup":
            assert out.filter("length(text) <> n_chars and length(text) > 0").count() == docs.filter("length(text) <> n_chars").count()
        docs = out
    tokens = P.STAGES[-1][1](spark, docs, DATA)
    assert tokens.count() == docs.count() < whole and tokens.filter("not exact").count() == 0


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, "a text without an id", "en", "s", None, 1), (1, None, None, None, None, 2), (2, "", "x", "y", 0, 3), (3, "same", "x", "y", 4, 4), (3, "same", "x", "y", 4, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __was long")
    for name, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, DATA), name)
    assert docs.count() == 3


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = P.materialise(stage(spark, docs, DATA), name)
    assert docs.count() == 0
