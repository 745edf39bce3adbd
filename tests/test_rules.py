"""Hand cases of the rules: labels, panel ties, effect labels, intervals, the selection rule, sources and sinks."""

import hashlib
import json
import math
import warnings

import pytest
from pyspark.sql import functions as F

from surveyeval.functions import scoring as S
from surveyeval.operators import decide as D
from surveyeval.operators import questions as Q
from surveyeval.operators import resample as RS
from surveyeval.operators import stats as ST
from surveyeval.operators import tables as T
from surveyeval.sources import microdata as M


def test_labels(spark):
    empty = ["NA", " n/a ", "N.A.", "dk", "DK/NA", "na/dk", "", "  ", "REFUSED", "No answer", "Don't know", "do not know", "Inapplicable", "not applicable", "Skipped on Web", "uncodable", "IAP: x", "not asked", "Not in survey"]
    full = ["cannot choose", "not available", "skipped work", "Banana", "nap", "dont know", "uncodeable"]
    rows = spark.createDataFrame([(x,) for x in [*empty, *full, None]], "l string").select("l", S.non_substantive(F.col("l")).alias("e")).collect()
    assert [r["l"] for r in rows if r["e"]] == empty
    clean = {"Other (SPECIFY)": "Other", "Other (please specify)": "Other", "5.0": "5", "Version 2.0": "Version 2.0", "-3.0": "-3", "STRONGLY AGREE": "Strongly agree", "iPhone": "iPhone"}
    got = spark.createDataFrame([(x,) for x in clean], "l string").select("l", S.clean_label(F.col("l")).alias("c")).collect()
    assert {r["l"]: r["c"] for r in got} == clean


def _panel_row(spark, item, fmt, lo, hi, codes, ok=True):
    return [(5, f"m{i}", "P1", "Full", item, lo, hi, fmt, 1, c, c is not None and ok) for i, c in enumerate(codes)]


def _pick(item, rid, codes, options):
    key = f"{item}|{rid}|{','.join(map(str, sorted(codes)))}|{','.join(map(str, sorted(options)))}"
    return sorted(options)[int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % len(options)]


def test_panel_code(spark):
    schema = "rid long, model string, prompt string, condition string, item string, lo long, hi long, fmt string, sample long, pred_code long, parse_ok boolean"
    cases = {  # item: (format, lo, hi, codes, wanted)
        "L1": ("likert5", 1, 5, [1, 2, 4, 5], 3), "L2": ("likert5", 1, 5, [1, 2, 3, 5], None), "B1": ("binary", 1, 2, [1, 1, 1, 2], 1), "B2": ("binary", 1, 2, [1, 2, 1, 2], None),
        "C1": ("categorical", 1, 9, [9, 9, 1, 2], 9), "P1": ("contingent", 0, 7, [7, 7, 0, 1], 7), "P2": ("contingent", 0, 7, [0, 1, 3, 6], 2), "X": ("likert5", 1, 5, [1, None, 2, 3], "fail"),
    }
    df = spark.createDataFrame([r for item, (fmt, lo, hi, codes, _) in cases.items() for r in _panel_row(spark, item, fmt, lo, hi, codes)] + _panel_row(spark, "short", "binary", 1, 2, [1, 2, 1]), schema)
    got = {r["item"]: r["panel_code"] for r in T.panel_code(df, [f"m{i}" for i in range(4)]).collect()}
    want = {item: w for item, (_, _, _, _, w) in cases.items()}
    want |= {"L2": _pick("L2", 5, [1, 2, 3, 5], [2, 3]), "B2": _pick("B2", 5, [1, 2, 1, 2], [1, 2]), "X": None}
    assert got == want
    gaps = T.panel_code(df.where("item = 'L1'"), [f"m{i}" for i in range(4)], F.array(*[F.lit(x).cast("long") for x in (1, 5)])).first()["panel_code"]
    assert gaps == _pick("L1", 5, [1, 2, 4, 5], [1, 5])


def test_effects_are_signed(spark):
    got = [r[0] for r in spark.createDataFrame([(-0.3,), (0.0199,), (0.02,), (0.05,)], "d double").select(S.effect_label(F.col("d"))).collect()]
    assert got == ["small", "small", "modest", "substantive"]
    rows = [(r, i, c, 0, "m", True, 0.9 if c == "Full" else 0.6 + 0.001 * (r % 7)) for r in range(60) for i in ("A", "B") for c in ("Full", "random_battery_drop")]
    df = spark.createDataFrame(rows, "rid long, item string, condition string, battery_no long, model string, parse_ok boolean, err double")
    out = RS.battery_drops(df, spark.createDataFrame([(0, "b0", "bin")], "battery_no long, battery string, bin string"), B=200).first()
    assert out["delta"] < -0.25 and out["effect"] == "small" and not out["substantive"]


def test_intervals_by_group(spark):
    df = spark.range(400).select(F.col("id").alias("rid"), (F.col("id") % 10).cast("double").alias("s"), F.lit(1.0).alias("c"), F.lit("a").alias("g"))
    few = spark.range(5).select((F.col("id") + 1000).alias("rid"), F.col("id").cast("double").alias("s"), F.lit(1.0).alias("c"), F.lit("few").alias("g"))
    rows = {r["g"]: r for r in ST.ratio_intervals(df.unionByName(df.withColumn("g", F.lit("b")).withColumn("s", F.col("s") + 1)).unionByName(few), ["g"], "s", "c", B=2000).collect()}
    se = math.sqrt(8.25 / 400)
    for g, mean in (("a", 4.5), ("b", 5.5)):
        assert abs(rows[g]["point"] - mean) < 1e-9 and abs(rows[g]["lo"] - (mean - 1.96 * se)) < 0.06 and abs(rows[g]["hi"] - (mean + 1.96 * se)) < 0.06 and rows[g]["p"] < 0.01
    assert rows["b"]["lo"] - rows["a"]["lo"] == pytest.approx(1.0, abs=0.02)  # the groups share their weights
    assert rows["few"]["n"] == 5 and rows["few"]["lo"] is None and rows["few"]["hi"] is None
    loose = ST.ratio_intervals(few, ["g"], "s", "c", method="percentile").first()
    assert loose["lo"] < 2 < loose["hi"]
    assert ST.ratio_ci(df.limit(0), "s", "c")["n"] == 0


@pytest.mark.parametrize(
    ("cells", "rationale", "chosen"),
    [
        ([("a", "P1", 0.20, 0.19, 0.21, 1.0, True), ("b", "P1", 0.30, 0.29, 0.31, 0.1, True)], "ci_unique_argmin", [("a", "P1")]),
        ([("a", "P1", 0.20, 0.10, 0.30, 1.0, True), ("b", "P1", 0.25, 0.15, 0.35, 0.1, True), ("c", "P1", 0.9, 0.8, 1.0, 0.01, True)], "ci_overlap_cost_break", [("b", "P1")]),
        ([("a", "P1", 0.20, 0.10, 0.30, 1.0, True), ("b", "P1", 0.25, 0.15, 0.35, 1.005, True), ("z", "P0", 0.9, 0.8, 1.0, 0.01, True)], "fallback_named", [("z", "P0")]),
        ([("a", "P1", 0.20, 0.10, 0.30, 1.0, False), ("b", "P1", None, None, None, 1.0, True)], "all_dq_fail_pause", []),
        ([("a", "P1", 0.10, 0.05, 0.15, 1.0, False), ("b", "P1", 0.25, 0.15, 0.35, 1.0, True)], "ci_unique_argmin", [("b", "P1")]),
    ],
)
def test_selection_rule(spark, cells, rationale, chosen):
    df = spark.createDataFrame(cells, "model string, prompt string, macro double, lo double, hi double, cost_score double, survives boolean")
    rows = D.apply_rule(df, ("z", "P0")).collect()
    assert {r["rationale"] for r in rows} == {rationale} and [(r["model"], r["prompt"]) for r in rows if r["chosen"]] == chosen


def test_questions(spark):
    labels = spark.createDataFrame([("HAPPY", 1, "Very"), ("HAPPY", 5, "Not"), ("HAPPY", 8, "Don't know"), ("HAPPY", -99, "x"), ("GUN", 1, "Yes"), ("GUN", 2, "No"), ("GUN", 3, "REFUSED")], "var string, code long, label string")
    names = spark.createDataFrame([("HAPPY", "general happiness")], "var string, label string")
    stems = spark.createDataFrame([("GUN", "Own a gun?")], "var string, stem string")
    rows = {r["var"]: r for r in Q.question_text(Q.scale_options(labels), names, stems, ["HAPPY"]).collect()}
    assert rows["GUN"]["question"] == "Survey question: Own a gun?\n\nOptions:\n  1. Yes\n  2. No\n\nOutput ONLY a single integer code (1-2)." and rows["GUN"]["valid_codes"] == [1, 2]
    assert rows["HAPPY"]["question"].startswith("Survey question: general happiness\n\nOptions:\n  1. Very\n  5. Not\n\nOutput ONLY a single integer code from 1 to 5. ") and rows["HAPPY"]["valid_codes"] == [1, 2, 3, 4, 5]


def test_load_and_reference_files(spark, tmp_path):
    df = spark.createDataFrame([(2024.0, 1, 2), (2022.0, 3, 4)], "YEAR double, A int, B int")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        rows, missing = M.load_year(df, 2024, ["A", "NOPE"])
    assert missing == ["NOPE"] and len(seen) == 1 and [tuple(r) for r in rows.collect()] == [(1, 2024.0)] and M.load_year(df, None)[0].count() == 2
    with pytest.raises(ValueError):
        M.load_year(df.drop("YEAR"), 2024)
    (tmp_path / "ref.json").write_text(json.dumps({"A": 1.5, "B": 2}, indent=1))
    assert {tuple(r) for r in M.json_table(spark, str(tmp_path / "ref.json"), "double").collect()} == {("A", 1.5), ("B", 2.0)}
    (tmp_path / "map.json").write_text(json.dumps({"b1": ["X", "Y"]}))
    assert [tuple(r) for r in M.json_table(spark, str(tmp_path / "map.json"), "array<string>").collect()] == [("b1", ["X", "Y"])]
    (tmp_path / "many.json").write_text(json.dumps([{"respondent_id": i, "condition": "full"} for i in range(3)], indent=2))
    assert M.records_array(spark, str(tmp_path / "many.json")).count() == 3
    (tmp_path / "p.csv").write_text("id,x,n,s\n1,0.5,7.0,a\n2,,x, \n")
    assert [tuple(r) for r in M.predictions_csv(spark, str(tmp_path / "p.csv"), "id long, n int, x double, s string").orderBy("id").collect()] == [(1, 7, 0.5, "a"), (2, None, None, None)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "m", "P1", "Full", "A", 3), (2, "m", "P1", "drop", "A", 4)], "rid int, model string, prompt string, condition string, item string, extra int")
    path = str(tmp_path / "long.parquet")
    M.write_long(df, path)
    back = spark.read.parquet(path)
    assert len(back.columns) == 19 and "extra" not in back.columns and dict(back.dtypes)["respondent_id"] == "int" and {r["condition"] for r in back.collect()} == {"Full", "drop"}
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        M.write_long(df, path)
    with pytest.raises(ValueError):
        M.write_long(df, str(tmp_path / "main"), protected=str(tmp_path / "main"))
    M.write_tables({"T0": df.groupBy("item").count()}, str(tmp_path), "main")
    assert spark.read.parquet(str(tmp_path / "main/T0.parquet")).count() == spark.read.json(str(tmp_path / "main/T0.json")).count() == spark.read.option("header", True).csv(str(tmp_path / "main/T0.csv")).count() == 1
