"""Hand-computed cases, closed forms and oracle parity for the survey operators."""

import json
import math

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from surveyeval.functions import scoring as S
from surveyeval.operators import sets as X
from surveyeval.operators import stats as ST
from surveyeval.operators import tables as T
from surveyeval.operators import text as TX
from surveyeval.operators import report as R
from surveyeval.plans import composed_queries, more_queries, report_queries, table_queries  # noqa: F401  (register their queries)
from surveyeval.plans.queries import ORACLE_SQL, QUERIES
from surveyeval.sources import microdata as M
from surveyeval.streaming import health as H

SF = "/root/testdata/sf0.001"


def test_parse_response(spark):
    cases = [("4", 4), (" 4 ", 4), ("I would say 4", 4), ("4. Moderate", 4), ("8", None), ("definitely four", None), ("", None), (None, None)]
    rows = spark.createDataFrame(cases, "raw string, want int").select("want", S.parse_response(F.col("raw"), F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("got")).collect()
    assert [r["got"] for r in rows] == [c[1] for c in cases]


def test_missing_and_labels(spark):
    df = spark.createDataFrame([(-99, "Yes"), (1, "Don't know"), (2, "  Refused "), (3, "Agree"), (None, "x"), (4, None)], "code int, label string")
    got = [r[0] for r in df.select(S.truth_code(F.col("code"), F.col("label"))).collect()]
    assert got == [None, None, None, 3, None, 4]
    label = spark.createDataFrame([("STRONG DEMOCRAT (SPECIFY)",), ("12.0",), ("Mixed Case",)], "x string").select(S.clean_label(F.col("x"))).collect()
    assert [r[0] for r in label] == ["Strong democrat", "12", "Mixed Case"]


def test_hash_pick(spark):
    assert spark.range(1).select(S.hash_pick(F.lit("42|7|P1"), F.lit(4))).first()[0] == 1


def test_text_answers(spark):
    df = spark.createDataFrame([("two or three, say 4",), ("none",), ("9 then five",)], "t string")
    assert [r[0] for r in df.select(TX.likert_answer(F.col("t"), 5)).collect()] == [4, None, 5]
    assert spark.createDataFrame([("not Agree but Disagree",)], "t string").select(TX.last_option(F.col("t"), ["agree", "disagree", "neutral"])).first()[0] in ("agree", "disagree")
    m = spark.createDataFrame([("never", "never/rarely", True), ("weekly", "monthly", False), ("", "x", False)], "p string, t string, w boolean")
    assert all(r[0] == r[1] for r in m.select(TX.option_match(F.col("p"), F.col("t")), "w").collect())
    u = spark.createDataFrame([(1, "Interviewer: hello\nhow are you\nRespondent: fine")], "doc_id long, text string")
    assert [(r["role"], r["utterance"]) for r in TX.utterances(u).orderBy("n").collect()] == [("Interviewer", "hello how are you"), ("Respondent", "fine")]


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "fam string, key string, p double")
    got = {r["key"]: (round(r["p_adj"], 6), r["significant"]) for r in T.holm(df, ["fam"]).collect()}
    assert got == {"a": (0.03, True), "c": (0.06, False), "b": (0.06, False)}


def test_shapley_additive(spark):
    parts = [0.5, 0.3, 0.15, 0.05]
    rows = [(m, 1.5 - sum(parts[i] for i in range(4) if m >> i & 1)) for m in range(16)]
    df = spark.createDataFrame(rows, "mask long, value double")
    assert {r["player"]: r["shapley"] for r in ST.shapley(df).collect()} == dict(enumerate(parts))
    assert ST.interaction_share(ST.contrasts(df)).first()[0] == 0.0


def test_bootstrap(spark):
    df = spark.range(400).select(F.col("id").alias("rid"), (F.col("id") % 10).cast("double").alias("s"), F.lit(1.0).alias("c"))
    ci = ST.ratio_ci(df, "s", "c", B=2000)
    se = math.sqrt(8.25 / 400)
    assert abs(ci["point"] - 4.5) < 1e-9 and abs(ci["lo"] - (4.5 - 1.96 * se)) < 0.06 and abs(ci["hi"] - (4.5 + 1.96 * se)) < 0.06
    assert ST.ratio_ci(df.repartition(7), "s", "c", B=2000) == pytest.approx(ci, abs=1e-9)  # sums differ in their last bits
    flat = ST.ratio_ci(df.withColumn("s", F.lit(0.5)), "s", "c", B=200)
    assert flat["lo"] == flat["hi"] == 0.5


def test_ols_and_ridge(spark):
    df = spark.range(200).select(F.col("id").alias("rid"), (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 4).alias("fold"), (2.0 + 3.0 * (F.col("id") % 5)).alias("y"))
    fit = {r["term"]: r["coef"] for r in ST.clustered_ols(df, ["x"], "y")}
    assert abs(fit["intercept"] - 2) < 1e-6 and abs(fit["x"] - 3) < 1e-6
    assert all(abs(b[1] - 3) < 0.05 for b in ST.ridge_folds(df, ["x"], "y").values())


def test_sources(spark, tmp_path):
    (tmp_path / "data.txt").write_text("2024 1 3\n2024 2-9\n2024 3 x\n")
    got = [tuple(r) for r in M.fixed_width(spark, str(tmp_path / "data.txt"), [("YEAR", 1, 4), ("ID", 5, 6), ("V", 7, 8)]).collect()]
    assert got == [(2024.0, 1.0, 3.0), (2024.0, 2.0, -9.0), (2024.0, 3.0, None)]
    (tmp_path / "book.do").write_text('infix\n  int year 1 - 4\n  int v 7 - 8\nusing data.txt\nlabel variable v "A question"\nlabel define S1\n  1 "Yes"\n  2 "No"\nlabel values v S1\n')
    v, l, c = M.codebook(spark, str(tmp_path / "book.do"))
    assert {(r["var"], r["start"], r["end"]) for r in v.collect()} == {("YEAR", 1, 4), ("V", 7, 8)}
    assert [tuple(r) for r in l.collect()] == [("V", "A question")] and {tuple(r) for r in c.collect()} == {("V", 1, "Yes"), ("V", 2, "No")}
    a = spark.createDataFrame([(1, 5), (2, 6)], "id int, a int")
    b = spark.createDataFrame([(2, 8), (1, 7)], "id int, b int")
    assert {tuple(r) for r in M.align_batches(a, b, ["id"]).collect()} == {(1, 5, 7), (2, 6, 8)}
    with pytest.raises(ValueError):
        M.align_batches(a, b.where("id = 1"), ["id"])


def test_records_and_sinks(spark, tmp_path):
    rec = {"respondent_id": 1, "condition": "full", "model": "m", "prompt_id": "P1", "per_item_scores": {"A": [{"truth": 2, "persona_code": 3, "parse_fail": False, "treatment": "likert", "abs_err": 1.0}, {"truth": 2, "parse_fail": True, "treatment": "likert"}], "B": [{"truth": None}]}}
    (tmp_path / "r.json").write_text(json.dumps(rec))
    rows = M.explode_records(M.records_json(spark, str(tmp_path / "r.json"))).orderBy("sample").collect()
    assert [(r["item"], r["sample"], r["pred_code"], r["abs_err"]) for r in rows] == [("A", 1, 3, 1), ("A", 2, None, None)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "store")
    df.write.parquet(path)
    more = spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string")
    assert M.append_new(spark, more, path, ["k"]) == 1 and M.append_new(spark, more, path, ["k"]) == 0
    with pytest.raises(ValueError):
        M.partial_guard(5, 1000)
    old = spark.sql("select 1 as k, map('a', 1, 'b', 2) as m")
    assert M.upsert(old, spark.sql("select 1 as k, map('b', 9) as m"), ["k"], "m").first()["m"] == {"a": 1, "b": 9}


def test_streaming(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    twice = events.unionByName(events.where("event_id % 2 = 0"))
    twice.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = H.ingest(stream, late="400 days").writeStream.format("memory").queryName("ingested").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("ingested").count() == events.select("event_id").distinct().count()
    h = H.health(stream, late="400 days").writeStream.outputMode("complete").format("memory").queryName("health").trigger(availableNow=True).start()
    h.awaitTermination()
    assert spark.table("health").agg(F.sum("n")).first()[0] == twice.count()


def test_sets(spark):
    a, b = spark.range(5), spark.range(3, 8)
    assert tuple(X.membership(a, b).first()) == (2, 3, 3)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "nation customer orders events documents labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = con.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(rows(got), rows(want), check_dtype=False, check_exact=False, atol=1e-6)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_single_model_takes_the_cheapest_within_the_window(spark):
    errors = {"a": (1.04, 2.0), "b": (1.0, 3.0), "c": (1.2, 0.5)}
    rows = [(m, rid, 100.0 * e[rid], True, "likert7") for m, e in errors.items() for rid in (0, 1)]
    df = spark.createDataFrame(rows, "model string, rid long, abs_err double, parse_ok boolean, fmt string")
    parts = spark.createDataFrame([(0, "train"), (1, "test")], "rid long, part string")
    rates = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.05)], "model string, rate double")
    assert [tuple(r) for r in R.single_model(df, parts, rates).collect()] == [("a", 104.0, 200.0)]


def test_coverage_counts_all_respondents(spark):
    truth = spark.createDataFrame([("X", 1), ("X", 2), ("Y", 1)], "item string, rid long")
    got = {r["item"]: (r["n"], r["percent"]) for r in R.coverage(truth, spark.range(4)).collect()}
    assert got == {"X": (2, 50.0), "Y": (1, 25.0)}
