"""Shuffles behind filters: large benchmarks in decontamination, untouched texts in line dedup; clashing row ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from surveyeval.llm import decontaminate, line_dedup, shared

SF = "/root/testdata/sf0.001"


def test_decontamination_of_large_benchmarks_is_the_same(spark, monkeypatch):
    want = sorted(map(tuple, decontaminate.op8_decontaminate(spark, SF).collect()))
    docs = spark.createDataFrame([(1, "a b c x"), (2, "x a b"), (3, "b c"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("s", "a b c"), ("t", "b c"), ("u", None), ("v", " ")], "item_id string, text string")
    few = sorted(map(tuple, decontaminate.contamination(docs, items).select("doc_id", "n_hit", "items").collect()))
    assert few == [(1, 3, ["s", "t"]), (2, 0, []), (3, 2, ["t"]), (4, 0, [])]
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)  # every table counts as too large to broadcast
    assert sorted(map(tuple, decontaminate.op8_decontaminate(spark, SF).collect())) == want
    assert sorted(map(tuple, decontaminate.contamination(docs, items).select("doc_id", "n_hit", "items").collect())) == few


def test_texts_without_drops_are_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs)
    kept = line_dedup.apply_keep_bitmaps(docs, bitmaps)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and kept.count() == docs.count()
    both = kept.join(bitmaps.select("doc_id", F.col("n_lines").alias("n"), F.col("n_dropped").alias("d")), "doc_id")
    assert both.where("n <> n_lines or d <> n_dropped").count() == 0 and both.count() == docs.count()
    assert kept.where("n_dropped > 0").count() > 0


def test_line_dedup_with_one_row_id_for_all(spark, monkeypatch):
    """Row ids are hashes; documents that meet in one are told apart by their doc_id."""
    rows = [(1, "the first long line\nsecond long line here"), (2, "second long line here\nown words stay"), (3, "x\ny\nthe first long line"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "_row_id", lambda doc_id, text: F.lit(7).cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.apply_keep_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()}
    assert got == {1: (rows[0][1], 2, 0), 2: ("own words stay", 2, 1), 3: ("x\ny", 3, 1), None: (None, 1, 0)}
