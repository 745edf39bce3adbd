"""Co-training: both views teach, both classes are exchanged, long texts keep their content, odd metadata do no harm."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from surveyeval.llm import quality


def corpus(spark, n=600):
    """Good pages speak of gardens, bad ones of casinos; bad pages are also short, shouted and from one source; a few of each look like the other view's opposite."""
    rows, labels = [], []
    for i in range(n):
        good = i % 2 == 0
        words = ["garden", "soil", "water", "spring", "leaf"] if good else ["casino", "bonus", "win", "spin", "deal"]
        body = " ".join(f"{words[(i * j) % 5]} item{(i * 7 + j) % 50}" for j in range(40 if good else 12))
        rows.append((i, (body + ".\n" + body) if good else body.upper() + " !!!", "books" if good else f"web{i % 3}", "en", str(len(body)) if i % 9 else "n/a"))
        if i < 120:
            labels.append((i, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_both_views_teach_both_classes(spark):
    docs, labels = corpus(spark)
    report: list[dict] = []
    out = {r["doc_id"]: r for r in quality.quality_scores(docs, labels, rounds=2, report=report).collect()}
    assert len(report) == 8 and all(x["rows"] > 0 for x in report)
    assert {(x["round"], x["teacher"], x["pupil"], x["class"]) for x in report} == {(r, t, p, c) for r in (1, 2) for t, p in (("content", "metadata"), ("metadata", "content")) for c in (0, 1)}
    by_direction: dict = {}
    for x in report:
        by_direction.setdefault((x["round"], x["teacher"]), []).append(x["rows"])
    assert all(max(v) <= 1.5 * min(v) for v in by_direction.values())  # the same number of both classes, drawn by hash
    assert all(r["keep"] == (d % 2 == 0) for d, r in out.items())
    assert sum((r["p_content"] >= 0.5) == (d % 2 == 0) for d, r in out.items()) > 0.98 * len(out) and sum((r["p_metadata"] >= 0.5) == (d % 2 == 0) for d, r in out.items()) > 0.98 * len(out)


def test_exchange_is_bounded(spark):
    docs, labels = corpus(spark)
    report: list[dict] = []
    quality.quality_scores(docs, labels, rounds=1, exchanged=10, report=report)
    assert all(x["rows"] <= 30 for x in report)  # drawn by hash: about ten


def test_long_texts_keep_their_content():
    """Two texts of thousands of different words stay far apart, and as long as any other."""
    texts = [" ".join(f"a{i}" for i in range(6000)), " ".join(f"b{i}" for i in range(6000)), "a1 a2 a3", "", None]
    text, place, value = quality.content_vectors(pa.array(texts))
    dense = np.zeros((5, quality.BUCKETS))
    dense[text, place] = value
    assert np.allclose(np.linalg.norm(dense, axis=1), [1, 1, 1, 0, 0]) and dense[0] @ dense[1] < 0.1


def test_rows_without_metadata(spark):
    docs, labels = corpus(spark, 200)
    bare = docs.select("doc_id", "text", F.lit(None).cast("double").alias("n_chars"), F.lit(1).alias("rid"), F.lit("x").alias("content"))
    out = quality.quality_scores(bare.unionByName(bare.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long"))), labels, rounds=1).collect()
    assert len(out) == 201 and {r["doc_id"] for r in out} == {None, *range(200)}
