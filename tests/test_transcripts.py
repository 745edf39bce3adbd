"""Transcript answers, option lists and profiles by prompt on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from surveyeval.operators import profiles as PF
from surveyeval.operators import tables as T
from surveyeval.operators import text as TX
from surveyeval.operators import transcripts as TR

HAPPY = [("Not too happy", r"\bnot\W+too\W+happy\b"), ("Pretty happy", r"\bpretty\W+happy\b"), ("Very happy", r"\bvery\W+happy\b")]
ITEMS = {"trust": (r"how\W+much\W+trust", ("scale", 5)), "happy": (r"how\W+happy", ("ordered", HAPPY)), "region": (r"US\W+region", ("categorical", [("South", "south"), ("West", "west")]))}
TALKS = {
    # a re-prompt is skipped, the confirmation's first sentence decides
    1: [("assistant", "How much trust do you have?"), ("user", "about a two"), ("assistant", "Sorry, could you repeat that?"), ("user", "I said 4"), ("assistant", "I'll mark 3. You said 5 before."), ("user", "fine, 1")],
    # no confirmation: the next question ends the answer, the user's last number counts
    2: [("assistant", "how much TRUST?"), ("user", "one, no, fifth"), ("assistant", "How happy are you?"), ("user", "I am pretty happy"), ("assistant", "Noted. I have recorded very happy here."), ("assistant", "Which US region?"), ("user", "the west"), ("assistant", "I have noted the South.")],
    # never answered, then the same question again: the first one decides
    3: [("system", "How much trust"), ("assistant", "How much trust?"), ("assistant", "How much trust, again?"), ("user", "5")],
    # the answer comes after more than 15 turns
    4: [("assistant", "How much trust?"), *[("assistant", "sorry")] * 15, ("user", "3")],
    # exactly the last turn that counts
    5: [("assistant", "How much trust?"), *[("assistant", "please state that again")] * 14, ("user", "3")],
    6: [("user", "How much trust? 5"), ("assistant", None), ("user", None)],
    7: [("assistant", "How much trust?"), ("user", "10 or 45"), ("assistant", "I've noted a 44")],
}


@pytest.fixture(scope="module")
def got(spark):
    rows = [(c, t, role, text) for c, talk in TALKS.items() for t, (role, text) in enumerate(talk)] + [(None, 0, "assistant", "How happy?"), (9, None, "assistant", "How happy?")]
    out = TR.transcript_answers(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5), ITEMS).collect()
    return {(r["conv_id"], r["item"]): r for r in out}


def test_confirmations_and_reprompts(got):
    r = got[1, "trust"]
    assert (r["anchor"], r["n_turns"], r["said"], r["confirmation"], r["value"]) == (0, 2, "about a two I said 4", "I'll mark 3.", "3")
    assert (got[2, "trust"]["said"], got[2, "trust"]["confirmation"], got[2, "trust"]["value"]) == ("one, no, fifth", None, "5")
    assert got[2, "happy"]["value"] == "Pretty happy" and got[2, "happy"]["confirmation"] == "Noted."
    assert got[2, "region"]["value"] == "West" and got[2, "region"]["confirmation"] == "I have noted the South."
    assert (got[3, "trust"]["anchor"], got[3, "trust"]["n_turns"], got[3, "trust"]["said"], got[3, "trust"]["value"]) == (1, 0, "", None)
    assert got[4, "trust"]["value"] is None and got[4, "trust"]["n_turns"] == 0 and got[5, "trust"]["value"] == "3"
    assert got[7, "trust"]["value"] is None and (6, "trust") not in got and set(got) == {(1, "trust"), (2, "trust"), (2, "happy"), (2, "region"), (3, "trust"), (4, "trust"), (5, "trust"), (7, "trust")}


def test_ordered_lists_prefer_the_confirmation(spark):
    rows = [(1, 0, "assistant", "How happy?"), (1, 1, "user", "very happy I guess"), (1, 2, "assistant", "I'll note not too happy. Really.")]
    out = TR.transcript_answers(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), ITEMS).first()
    assert (out["value"], out["confirmation"]) == ("Not too happy", "I'll note not too happy.")
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert TR.transcript_answers(none, ITEMS).count() == 0
    with pytest.raises(ValueError):
        TR.transcript_answers(none, {"x": ("x", ("odd", 1))})


def test_scale_values(spark):
    cases = [("a 3, then four", 5, 4), ("a 3, then four", 3, 3), ("the 2nd or sixth", 7, 6), ("the 2nd or sixth", 5, 2), ("12 of 34", 5, None), ("bone", 5, None), (None, 5, None), ("FIVE!", 5, 5)]
    for text, most, want in cases:
        assert spark.createDataFrame([(text,)], "t string").select(TR.scale_value(F.col("t"), most)).first()[0] == want


def test_options(spark):
    df = spark.createDataFrame([("Agree, or rather neutral",), ("the letter B",), ("blank",), (None,)], "t string")
    assert [r[0] for r in df.select(TR.latest_option(F.col("t"), ["agree", "neutral", "a", "b"])).collect()] == ["neutral", "b", None, None]
    assert [r[0] for r in df.select(TR.first_match(F.col("t"), [("n", "NEUTRAL"), ("a", "agree"), ("l", r"\bletter\b")])).collect()] == ["n", "l", None, None]
    m = [("I work full time", "full time, 35 hours", True, False), ("yes", "Yes", True, True), ("  ", "x", False, False), ("part", None, False, False), ("retired now", "Retired / keeping house", True, False), ("Working full  time", "working full time", True, True), ("no", "yes, no", True, True)]
    rows = spark.createDataFrame(m, "p string, t string, w boolean, s boolean")
    assert all(r[0] == r["w"] for r in rows.select(TX.option_match(F.col("p"), F.col("t")), "w").collect())
    shared = rows.select(TX.option_match(F.col("p"), F.col("t"), ["no", "maybe"]), "s").collect()
    assert all(r[0] == r["s"] for r in shared)


def test_profiles(spark):
    answers = spark.createDataFrame([(1, 2, 40.0, 1, -99), (2, None, None, 9, 1), (3, 1, 40.5, 1, 1)], "rid long, SEX int, AGE double, JOB int, HIDE int")
    labels = spark.createDataFrame([("SEX", 1, "MALE"), ("SEX", 2, "FEMALE"), ("AGE", 40, "40.0"), ("JOB", 1, "Other (Please Specify)"), ("JOB", 9, "Don't know"), ("HIDE", 1, "x")], "var string, code int, label string")
    bins = spark.createDataFrame([("SEX", "demographic"), ("AGE", "demographic"), ("JOB", "behavioral"), ("HIDE", "attitudinal")], "var string, bin string")
    names = spark.createDataFrame([("SEX", " sex of respondent ")], "var string, label string")
    f = PF.features_labelled(answers, ["SEX", "AGE", "JOB", "HIDE"], labels, bins, names, exclude=("HIDE",))
    assert {(r["rid"], r["var"], r["var_label"], r["label"]) for r in f.collect()} == {(1, "SEX", "sex of respondent", "FEMALE"), (1, "AGE", "AGE", "40"), (1, "JOB", "JOB", "Other"), (3, "SEX", "sex of respondent", "MALE"), (3, "JOB", "JOB", "Other")}
    templates = spark.createDataFrame([("SEX", "I am {val_lower}, not {val}; code {val_int} {other}.", None), ("AGE", "{val_int}{val_int} years", "How old?")], "var string, sentence string, question string")
    heads = {"demographic": "## D", "behavioral": "## B"}
    shown = {style: {r["rid"]: r for r in PF.render(f, answers, PF.Prompt(style, "Hello.", heads), templates).collect()} for style in PF.STYLES}
    assert shown["kv"][1]["profile"] == "Hello.\n\n## D\n- AGE: 40\n- sex of respondent: Female\n\n## B\n- JOB: Other\n" and shown["kv"][2]["profile"] == "Hello.\n"
    assert shown["prose"][1]["profile"] == "Hello.\n\n## D\n4040 years\nI am female, not FEMALE; code 2 {other}.\n\n## B\nOn JOB, I would say other.\n"
    assert shown["qa"][3]["profile"] == "Hello.\n\n## D\nInterviewer: What about sex of respondent?\nRespondent: Male.\n\n## B\nInterviewer: What about JOB?\nRespondent: Other.\n"
    assert (shown["qa"][1]["feature_count"], shown["qa"][1]["n_demographic"], shown["qa"][1]["n_behavioral"], shown["qa"][1]["n_attitudinal"]) == (3, 2, 1, 0)
    assert shown["kv"][1]["char_count"] == len(shown["kv"][1]["profile"]) and shown["kv"][1]["approx_tokens"] == len(shown["kv"][1]["profile"]) // 4
    only = PF.render(PF.features_labelled(answers, ["SEX", "JOB"], labels, bins, drop_bin="demographic"), answers, PF.Prompt("kv", "Hi", {"demographic": "## D"}))
    assert {r["profile"] for r in only.collect()} == {"Hi\n"}
    with pytest.raises(ValueError):
        PF.lines(f, "verse")


def test_rounding_does_not_depend_on_the_order_of_sums(spark):
    """An exact half at the sixth place, reached by sums whose last bits differ."""
    values = [0.1, 0.2, 0.3, 0.2757500]  # mean 0.2189375
    sums = [sum(x) / 4 for x in ([*values], values[::-1], [values[2], values[3], values[0], values[1]])]
    df = spark.createDataFrame([(s,) for s in [*sums, 0.21893749999999997, 0.2189375, 0.21893750000000004]], "x double")
    assert {r[0] for r in df.select(T.r6(F.col("x"))).collect()} == {0.218938}


def test_effects_by_hand(spark):
    rows = [(1, "A", "m", "p", 1, 0.0, 1.0), (1, "A", "m", "p", 2, 1.0, 0.0), (1, "B", "m", "p", 1, 0.5, 0.0), (1, "A", "n", "p", 1, 1.0, 0.0), (2, "A", "m", "q", 1, 0.25, 1.0)]
    df = spark.createDataFrame(rows, "rid long, item string, model string, prompt string, sample int, err double, exact0 double").withColumn("lo", F.lit(1)).withColumn("hi", F.lit(4))
    got = {(r["factor"], r["level"]): (r["err"], r["exact"], r["n"], r["n_respondents"]) for r in T.main_effects(df).collect()}
    assert got == {("model", "m"): (0.375, 0.625, 4, 2), ("model", "n"): (1.0, 0.0, 1, 1), ("prompt", "p"): (round((0.5 + 0.5 + 1.0) / 3, 6), round(0.5 / 3, 6), 4, 1), ("prompt", "q"): (0.25, 1.0, 1, 1)}
    truth = spark.createDataFrame([(1, "A", 2), (2, "A", 2), (3, "A", 1), (1, "B", 4)], "rid long, item string, true_code long")
    a = {r["item"]: r for r in T.item_difficulty(df, truth).collect()}
    assert (a["A"]["err"], a["A"]["exact"], a["A"]["maj_em"], a["A"]["uniform_em"], a["A"]["k"], a["A"]["n"]) == (0.5, 0.625, 0.666667, 0.25, 4, 4)
    assert a["A"]["lift_maj"] == round((0.625 - 2 / 3) / (1 / 3), 6) and a["B"]["lift_maj"] is None
    ci = {r["item"]: r for r in T.item_difficulty_intervals(df, truth, B=200).collect()}
    assert ci["A"]["lo"] <= 0.5 <= ci["A"]["hi"] and ci["A"]["lo"] < ci["A"]["hi"]
    gap = T.policy_gap(df.withColumn("condition", F.lit("Full")).withColumn("err_opt", F.when(F.col("err") < 1, F.col("err")))).first()
    assert gap["conservative"] == round((0.625 + 0.25) / 2, 6) and gap["optimistic"] == 0.25 and gap["gap"] == 0.1875
