"""Columns of the caller whose names the stages use inside, rows that repeat, and what removes without the tree's scan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__

if not __spark_entry__.corpus:
    pytest.skip("no corpus subpackage", allow_module_level=True)

import corpus_pipeline
from circlet.llm import suffix_dedup

NAMES = ("_k", "_id", "_key", "_sx_d", "_sx_t", "_sx_spans", "_own0_x", "n_chars")


def passage(x, n=40):
    return " ".join(f"{x}{i}" for i in range(n))


def test_the_caller_s_columns_pass(spark):
    rows = [(1, passage("a"), "en", "s"), (2, passage("a") + " more", "en", "s"), (3, passage("b") + " " + passage("c", 30), "en", "s"), (4, passage("d", 90) + " " + passage("c", 30), "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in NAMES if c != "n_chars"}).withColumn("n_chars", F.length("text").cast("long"))
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    cut = corpus_pipeline.without_repeats(spark, kept, "")
    for out in (kept, cut):
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == [1, 3, 4]
        assert all(r[c] == f"{c}:{r.doc_id}" for r in got for c in NAMES if c != "n_chars")
    text = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    assert text[3][0] == rows[2][1] and passage("c", 30) not in text[4][0] and all(len(t) == n for t, n in text.values())


def test_rows_that_repeat_are_searched_once(spark):
    text = passage("r", 30)
    docs = spark.createDataFrame([(None, text)] * 1000 + [(5, text), (6, "x" * 60), (6, "x" * 60)], "doc_id long, text string").repartition(3)
    spans = suffix_dedup.spans(suffix_dedup.keyed(docs))
    row = spans.where(f"d = {suffix_dedup.LAST}").collect()
    assert len(row) == 1 and len(row[0].spans) < len(text)
    got = suffix_dedup.report(docs).collect()
    assert len(got) == 1003 and {r.n_removed for r in got if r.doc_id is None} == {len(text)}
    assert {r.n_removed for r in got if r.doc_id is not None} == {0}


@pytest.mark.parametrize("split", [suffix_dedup.SPLIT, 0])
def test_only_the_scan_removes(spark, monkeypatch, split):
    """Copies of one context are an interval of the tree like others: with no intervals nothing goes."""
    docs = spark.createDataFrame([(i, passage("a") if i % 2 else passage(f"z{i}") + passage("a")) for i in range(8)], "doc_id long, text string")
    assert sum(r.n_removed for r in suffix_dedup.report(docs, split).collect()) > 0
    here = suffix_dedup.settle

    def without_scan(pdf):
        # Workers go on to serve other tests.
        scan, suffix_dedup.maximal_repeats = suffix_dedup.maximal_repeats, lambda *a: []
        try:
            return here(pdf)
        finally:
            suffix_dedup.maximal_repeats = scan

    monkeypatch.setattr(suffix_dedup, "settle", without_scan)
    assert suffix_dedup.spans(suffix_dedup.keyed(docs), split).count() == 0
