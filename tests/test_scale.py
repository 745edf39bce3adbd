"""Plans and partitions of the survey queries: what must not grow with the input."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  (registers every query)
from surveyeval.functions import scoring as S
from surveyeval.operators import resample as RS
from surveyeval.operators import stats as ST
from surveyeval.operators import tables as T
from surveyeval.plans import fixtures as FX
from surveyeval.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def crowd(spark, tmp_path_factory):
    """25,000 respondents in one file: five times what a partition should hold."""
    folder = tmp_path_factory.mktemp("crowd")
    spark.range(25_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(folder / "customer.parquet"))
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("make", [FX.truth, FX.predictions, FX.panel])
def test_respondents_are_dealt_to_partitions_of_bounded_size(spark, crowd, make):
    df = make(spark, crowd)
    sizes = [r["n"] for r in df.select("rid", F.spark_partition_id().alias("p")).distinct().groupBy("p").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 5 and sum(sizes) == 25_000 and max(sizes) <= 1.2 * FX.RESPONDENTS


@pytest.mark.parametrize("make, each", [(FX.truth, 8), (FX.predictions, 48), (FX.panel, 192)])
def test_spark_is_told_how_large_the_derived_tables_are(spark, crowd, make, each):
    df = make(spark, crowd)
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() >= 25_000 * each  # a byte a row at least


@pytest.mark.parametrize("name", ["st_router", "st_router_exact", "sel_single_model"])
def test_neither_answers_nor_parts_are_broadcast(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "ShuffledHashJoin [rid" in text and "BroadcastHashJoin [rid" not in text


def test_pairs_and_respondent_means_need_no_second_shuffle(spark, crowd):
    for df in (T.pair_ablation(T.scored(FX.predictions(spark, crowd))), T.scored(FX.panel(spark, crowd)).groupBy("rid", "model", "prompt").agg(F.avg("err"))):
        assert plan(df).count("Exchange hashpartitioning") == 1


def test_totals_of_groups_are_the_broadcast_side(spark):
    rows = spark.range(1000).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("g"), F.rand(1).alias("s"), F.lit(1.0).alias("c"))
    text = plan(ST.ratio_intervals(rows, ["g"], "s", "c", B=10))
    assert text.count("BroadcastHashJoin [g") == text.count("Inner, BuildRight") == 2


@pytest.mark.parametrize("digits, n", [(16, 4), (16, 1_000_003), (16, 2**31 - 1), (8, 7), (5, 3)])
def test_hash_pick_is_the_number_modulo_n(spark, digits, n):
    got = spark.range(300).select(F.col("id").cast("string").alias("x")).select("x", S.hash_pick(F.col("x"), F.lit(n), digits).alias("k")).collect()
    assert [r["k"] for r in got] == [int(hashlib.sha256(r["x"].encode()).hexdigest()[:digits], 16) % n for r in got]


def test_panel_code_of_every_vote_of_four(spark):
    """Against the definition, over all 7^4 votes: modes of nominal items, codes nearest to the median of the others; one of the candidates where they tie."""
    votes = [(a, b, c, d) for a in range(1, 8) for b in range(1, 8) for c in range(1, 8) for d in range(1, 8)]
    rows = [(i, m, v[j], fmt) for fmt in ("binary", "likert7", "contingent") for i, v in enumerate(votes) for j, m in enumerate(FX.MODELS)]
    df = spark.createDataFrame(rows, "rid long, model string, pred_code long, fmt string")
    df = df.select("*", F.lit("P1").alias("prompt"), F.lit("Full").alias("condition"), F.col("fmt").alias("item"), F.lit(1).alias("sample"), F.lit(True).alias("parse_ok"), F.lit(1).cast("long").alias("lo"), F.lit(7).cast("long").alias("hi"), F.col("rid").alias("true_code"))
    got = T.panel_code(df, FX.MODELS, facts=("true_code",)).collect()
    assert len(got) == 3 * len(votes)
    for r in got:
        codes = sorted(votes[r["rid"]])
        if r["fmt"] == "binary" or (r["fmt"] == "contingent" and 7 in codes):
            most = max(map(codes.count, codes))
            options = sorted({c for c in codes if codes.count(c) == most})
        else:
            far = {c: abs(2 * c - codes[1] - codes[2]) for c in range(1, 8)}
            options = [c for c in far if far[c] == min(far.values())]
        text = "|".join([r["item"], str(r["rid"]), ",".join(map(str, codes)), ",".join(map(str, options))])
        pick = 0 if len(options) == 1 else int(hashlib.sha256(text.encode()).hexdigest()[:8], 16) % len(options)
        assert (r["panel_code"], r["true_code"]) == (options[pick], r["rid"])


def test_replicates_of_cells_equal_those_of_wide_rows(spark):
    """A cluster's cells may be in several batches; groups that are not listed do not count; the plan has no column for each group."""
    df = spark.range(600).select((F.col("id") % 50).alias("rid"), F.concat(F.lit("g"), F.col("id") % 7).alias("g"), (F.col("id") * 37 % 11).alias("v"))
    groups = [f"g{i}" for i in range(5)]
    wide = df.groupBy("rid").agg(*[x for g in groups for x in (F.sum(F.when(F.col("g") == g, F.col("v"))).alias(f"v_{g}"), F.count(F.when(F.col("g") == g, 1)).alias(f"n_{g}"))])
    want = RS.replicates(wide, wide.columns[1:], B=20)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = RS.cell_replicates(df, [(g,) for g in groups], ["g"], ["v"], B=20)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.allclose(got[0], want[0]) and np.allclose(got[1], want[1]) and got[1].shape == (20, 10)
    none = RS.cell_replicates(df.where("false"), [("g0",)], ["g"], ["v"], B=3)
    assert none[0].tolist() == [0, 0] and none[1].shape == (3, 2)
