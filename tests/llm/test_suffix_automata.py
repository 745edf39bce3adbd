"""The suffix-automata search against brute force and against the windows that op6 finds."""

import random

import pytest
from pyspark.sql import functions as F

from surveyeval.llm import substring_dedup, suffix_automata

SPAN = " ".join(f"w{i}" for i in range(30))


def covered(found):
    return {(r["doc"], r["sub"], r["at"] + j) for r in found.collect() for j in range(r["n"])}


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(7)
    rows = [(i, " ".join(draw.choice("ab") if i % 3 else draw.choice("abcd") for _ in range(draw.randrange(90)))) for i in range(40)]
    rows += [(100, ""), (101, None), (102, SPAN + " tail"), (103, "head " + SPAN), (103, "other text " + SPAN), (103, "head " + SPAN), (104, "x " * 3000 + SPAN), (None, SPAN)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("sub", F.lit(1)).withColumn("body", F.lit("b"))


@pytest.mark.parametrize("size", [1500, 200_000])
def test_own_windows(spark, docs, size):
    """Any shard size gives the windows of the op6 query: small alphabets, texts longer than a shard, repeats in one text, shared doc_ids."""
    want = covered(substring_dedup.repeated_windows(docs, w=12))
    assert len(want) > 2000
    assert covered(suffix_automata.matching_windows(docs, w=12, shard_words=size)) == want


def test_reference(spark, docs):
    reference = spark.createDataFrame([(1, "a b a b b a b"), (2, None), (3, SPAN), (3, "x x x x x x")], "doc_id long, text string")
    held = {tuple(t.split()[i : i + 6]) for t in ("a b a b b a b", SPAN, "x x x x x x") for i in range(len(t.split()) - 5)}
    rows = docs.where("doc_id <> 103")
    want = {(r["doc_id"], 0, i) for r in rows.collect() for w in [(r["text"] or "").split()] for i in range(len(w) - 5) if tuple(w[i : i + 6]) in held}
    assert covered(suffix_automata.matching_windows(rows, reference, w=6, shard_words=8)) == want
    kept = substring_dedup.remove_windows(rows, suffix_automata.matching_windows(rows, reference, w=6), w=6)
    assert {r["doc_id"]: r["n_removed"] for r in kept.collect()}[104] == 3030


def test_empty(spark, docs):
    none = docs.where("false")
    assert suffix_automata.matching_windows(none).count() == 0
    assert suffix_automata.matching_windows(docs, none).count() == 0
    assert suffix_automata.matching_windows(none, docs).count() == 0
