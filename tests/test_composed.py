"""Hand-computed cases and closed forms of grids, checks, cell tables, resampling and regressions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyeval.operators import encode as E
from surveyeval.operators import grid as G
from surveyeval.operators import resample as RS
from surveyeval.operators import rescore as RC
from surveyeval.operators import stats as ST


def test_poisson_weights_are_poisson_and_depend_on_the_key_alone():
    keys = np.arange(5000, dtype=np.int64) * 7919
    w = ST.poisson_weights(keys, 40, 42)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert (ST.poisson_weights(keys[::-1].copy(), 40, 42)[:, ::-1] == w).all() and (ST.poisson_weights(keys, 40, 43) != w).any()
    assert abs(np.corrcoef(w)[np.triu_indices(40, 1)]).max() < 0.08


def test_shapley_intervals_of_additive_errors(spark):
    parts = [0.5, 0.3, 0.15, 0.05]
    rows = [(rid, m, 1.5 - sum(parts[i] for i in range(4) if m >> i & 1)) for rid in range(40) for m in range(16)]
    got = {r["term"]: r for r in RS.shapley_intervals(spark.createDataFrame(rows, "rid long, mask int, err double"), B=50)}
    for i, p in enumerate(parts):
        assert got[f"player_{i}"]["value"] == pytest.approx(p) and got[f"player_{i}"]["lo"] == pytest.approx(p)
    assert got["interaction_share"]["value"] == pytest.approx(0, abs=1e-12)
    with pytest.raises(ValueError):
        RS.shapley_intervals(spark.createDataFrame(rows[:10], "rid long, mask int, err double"), B=10)


def test_item_macro_weighs_items_equally(spark):
    rows = [(rid, "m", "A", 0.0, 1.0) for rid in range(30) for _ in range(9)] + [(rid, "m", "B", 1.0, 0.0) for rid in range(30)]
    r = RS.item_macro(spark.createDataFrame(rows, "rid long, model string, item string, err double, exact0 double"), ["m"], ["A", "B"], B=50)[0]
    assert r["err"] == 0.5 and r["err_lo"] == pytest.approx(0.5) and r["exact"] == 0.5


def test_router_learns_on_train_only(spark):
    rows = [(rid, i, m, e) for rid in range(20) for i, m, e in (("A", "x", 0.1), ("A", "y", 0.9), ("B", "x", 0.8), ("B", "y", 0.2))]
    parts = spark.createDataFrame([(rid, "train" if rid % 2 else "test") for rid in range(20)], "rid long, part string")
    got = {r["statistic"]: r["value"] for r in RS.router_intervals(spark.createDataFrame(rows, "rid long, item string, model string, err double"), parts, B=40)}
    assert got["routed"] == pytest.approx(0.15) and got["single"] == pytest.approx(0.45) and got["gap"] == pytest.approx(0.3)


def test_battery_drops(spark):
    rows = []
    for rid in range(100):
        for no, item, delta in ((0, "A", 0.06), (1, "B", 0.005)):
            noise = ((rid * 37 + no) % 11 - 5) / 1000
            rows += [(rid, item, "Full", None, True, 0.2), (rid, item, "random_battery_drop", no, True, 0.2 + delta + noise)]
    df = spark.createDataFrame(rows, "rid long, item string, condition string, battery_no long, parse_ok boolean, err double")
    table = spark.createDataFrame([(0, "strong", "x"), (1, "weak", "x")], "battery_no long, battery string, bin string")
    got = {r["battery"]: r for r in RS.battery_drops(df, table, B=200).collect()}
    assert got["strong"]["effect"] == "substantive" and got["strong"]["substantive"] and got["strong"]["rank"] == 1
    assert got["weak"]["effect"] == "small" and not got["weak"]["substantive"] and got["weak"]["n_pairs"] == 100
    with pytest.raises(ValueError):
        RS.battery_drops(df, table.union(spark.createDataFrame([(2, "none", "x")], table.schema)), B=20)


def test_encode(spark):
    df = spark.createDataFrame([(1, 1.0, "a", 5.0), (2, None, None, 5.0), (3, 3.0, "b", 5.0)], "rid long, n double, c string, flat double")
    rows, names = E.encode(df, ["n", "flat"], ["c"])
    assert names == ["n", "c=MISSING", "c=a", "c=b"]  # the flat column goes
    sd = np.std([1.0, 2.0, 3.0])
    assert [r["x0"] for r in rows.orderBy("rid").collect()] == pytest.approx([1 / sd, 2 / sd, 3 / sd])


def test_regressions_find_a_clean_rule(spark):
    df = spark.range(300).select((F.col("id") % 5).alias("fold"), (F.col("id") * 7 % 4).cast("double").alias("x0")).withColumn("item", F.lit("A"))
    few = df.limit(10).withColumn("item", F.lit("few"))
    got = E.ridge_by_item(df.union(few).withColumn("y", 1 + F.col("x0")), ["x0"]).collect()
    assert {r["item"] for r in got} == {"A"} and all(r["mae"] == 0 for r in got) and sum(r["n"] for r in got) == 300
    logit = E.logistic_folds(df.withColumn("y", (F.col("x0") >= 2).cast("double")), ["x0"]).collect()
    assert len(logit) == 5 and all(r["mae"] == 0 for r in logit)


def test_exclusion_and_leaks(spark):
    f = spark.createDataFrame([(1, "V", "b", "yes"), (1, "W", "b", "no")], "rid long, var string, bin string, label string")
    t = spark.createDataFrame([(1, "A"), (1, "B")], "rid long, item string")
    members = {"A": ("V",)}
    shown = lambda on: {(r["item"], r["var"]) for r in G.exclude_batteries(f, t, members, on).collect()}
    assert shown(True) == {("A", "W"), ("B", "V"), ("B", "W")} and ("A", "V") in shown(False)
    assert G.leaks(G.exclude_batteries(f, t, members), members).count() == 0
    assert [tuple(r) for r in G.leaks(G.exclude_batteries(f, t, members, False), members).collect()] == [(1, "A", "V")]


def test_format_and_section(spark):
    df = spark.createDataFrame([(1, "VERY {name} USA (Specify) 12.0"), (2, None), (3, "ok")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in G.format_flags(df).orderBy("doc_id").collect()] == [(1, True, True, True), (0, False, False, False), (0, False, False, False)]
    docs = spark.createDataFrame([(1, "a\nb stem c\nd"), (2, "x\ny anchor"), (3, "0123456789"), (4, None)], "doc_id long, text string")
    got = [tuple(r)[1:] for r in G.split_section(docs, ["stem", "other"], "anchor", 0.6).orderBy("doc_id").collect()]
    assert got == [("stem", "a\n", "b stem c\nd"), ("fallback", "x\n", "y anchor"), ("share", "012345", "6789"), ("share", "", "")]


def test_metadata_nulls_compare_as_values(spark):
    df = spark.createDataFrame([(1, "v1", None), (2, None, "a")], "rid long, version string, drop string")
    got = {(r["rid"], r["field"]) for r in G.metadata_mismatches(df, {"version": F.lit("v1"), "drop": F.lit(None).cast("string")}, ["rid"]).collect()}
    assert got == {(2, "version"), (2, "drop")}


def test_trait_rmse_reverses_items(spark):
    df = spark.createDataFrame([(1, "Full", "A", 1, 5, 5, 5, True), (1, "Full", "B", 1, 5, 1, 3, True)], "rid long, condition string, item string, lo long, hi long, true_code long, pred_code long, parse_ok boolean")
    r = RC.trait_rmse(df, {"t": [("A", False), ("B", True)]}).first()
    assert r["n_traits"] == 1 and r["rmse"] == 0.25  # true (1 + 1) / 2, predicted (1 + 0.5) / 2
