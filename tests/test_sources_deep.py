"""Codebooks of several batches, batches aligned by position, reference files, the stored long table, and restarts of the ingest."""

import json
import random

import pytest
from pyspark.sql import functions as F

from surveyeval.sources import codebooks as K
from surveyeval.sources import microdata as M
from surveyeval.streaming import health as H

# --- codebooks ---------------------------------------------------------------------------------------------------------

FIRST = """infix
YEAR 1 - 4
id_ 5 - 10
label variable NOT "inside infix blocks nothing else counts"
views 11 - 12
using first.dat;
label variable YEAR "survey year";
label variable views "first wording"
label variable views "political views"
label define S1
  1 "Liberal"
  7 "Conservative"
label values views S1;
  9 "after the block"
"""
SECOND = '''INFIX
YEAR 1 - 4
ID_ 5 - 10
VIEWS 11 - 13
trust 14 - 15
using second.dat
label variable VIEWS "loser"
label variable trust "can people be trusted"
label variable ghost "no columns"
label define S1
  1 "Can trust"
  2 "Can't be too ""careful"""
  -99 "No answer"
label values trust S1
label values VIEWS S1
'''


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_codebooks_side_by_side(spark, tmp_path):
    (tmp_path / "b0.do").write_text(FIRST)
    (tmp_path / "b1.do").write_text(SECOND.replace("\n", "\r\n"))
    both = K.read_codebooks(spark, [str(tmp_path / "b0.do"), str(tmp_path / "b1.do")])
    assert both.variables.where("file like '%b0.do'").count() == 3 and both.variables.where("file like '%b1.do'").count() == 4
    merged = K.merge_codebooks(both, ["b0.do", "b1.do"])
    assert rows(merged.variables, "var", "start", "end", "batch") == {("YEAR", 1, 4, 0), ("ID_", 5, 10, 0), ("VIEWS", 11, 12, 0), ("TRUST", 14, 15, 1)}
    assert rows(merged.labels, "var", "label") == {("YEAR", "survey year"), ("VIEWS", "political views"), ("TRUST", "can people be trusted")}
    assert rows(merged.links, "var", "set") == {("VIEWS", "b0_S1"), ("TRUST", "b1_S1")}
    assert rows(K.value_labels(merged), "var", "code", "label") == {("VIEWS", 1, "Liberal"), ("VIEWS", 7, "Conservative"), ("TRUST", 1, "Can trust"), ("TRUST", 2, 'Can\'t be too ""careful""'), ("TRUST", -99, "No answer")}
    other = K.merge_codebooks(both, ["b1.do", "b0.do"])
    assert ("VIEWS", 11, 13, 0) in rows(other.variables, "var", "start", "end", "batch") and ("VIEWS", "loser") in rows(other.labels, "var", "label")
    one = M.codebook(spark, str(tmp_path / "b1.do"))
    assert rows(one[1], "var", "label") == {("VIEWS", "loser"), ("TRUST", "can people be trusted"), ("GHOST", "no columns")} and one[2].where("var = 'VIEWS'").count() == 3


def test_empty_codebook(spark, tmp_path):
    (tmp_path / "empty.do").write_text("")
    book = K.read_codebooks(spark, str(tmp_path / "empty.do"))
    assert all(df.count() == 0 for df in (book.variables, book.labels, book.values, book.links))


# --- alignment ---------------------------------------------------------------------------------------------------------


def lines(ids, extra):
    return "".join(f"2024{i if i is not None else '':>6}{extra(n):>3}\n" for n, i in enumerate(ids))


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_positions_follow_the_file(spark, tmp_path, small_splits):
    (tmp_path / "a").mkdir()
    rng, want = random.Random(2), []
    for name, n in (("p1.dat", 20), ("p2.dat", 400), ("p3.dat", 3)):
        ids = [rng.randint(1, 50) for _ in range(n)]
        (tmp_path / "a" / name).write_text(lines(ids, lambda i: i % 9))
        want += ids
    df = K.positioned(spark, str(tmp_path / "a"), [("YEAR", 1, 4), ("ID_", 5, 10)])
    assert spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions() > 5
    assert [(r["position"], r["ID_"]) for r in df.orderBy("position").collect()] == list(enumerate(map(float, want)))


def test_align_by_position(spark, tmp_path, small_splits):
    ids = [1, 1, 2, None, 3, *range(4, 200), 7, 7]  # repeated and missing ids
    for name, of in (("a", lambda i: i % 9), ("b", lambda i: i % 5), ("c", lambda i: i % 3)):
        (tmp_path / f"{name}.dat").write_text(lines(ids, of))
    spec = lambda n: [("YEAR", 1, 4), ("ID_", 5, 10), (n, 11, 13)]
    parts = [K.positioned(spark, str(tmp_path / f"{n}.dat"), spec(n.upper())) for n in "abc"]
    out = K.align_batches(parts).orderBy("position").collect()
    assert out[0].asDict().keys() == {"position", "YEAR", "ID_", "A", "B", "C"}
    assert [(r["A"], r["B"], r["C"]) for r in out] == [(i % 9, i % 5, i % 3) for i in range(len(ids))] and [r["ID_"] for r in out] == ids
    shifted = [*ids[1:], ids[0]]
    (tmp_path / "s.dat").write_text(lines(shifted, lambda i: 0))
    with pytest.raises(ValueError, match=r"batch 0 and batch 1 differ at row 1 in \['ID_'\]"):
        K.align_batches([parts[0], K.positioned(spark, str(tmp_path / "s.dat"), spec("S"))])
    with pytest.raises(ValueError, match="different numbers of rows"):
        (tmp_path / "t.dat").write_text(lines(ids[:-1], lambda i: 0))
        K.align_batches([parts[0], K.positioned(spark, str(tmp_path / "t.dat"), spec("T"))])
    with pytest.raises(ValueError, match="several batches"):
        K.align_batches([parts[0], parts[1].withColumnRenamed("B", "A")])
    with pytest.raises(ValueError, match="positions"):
        K.align_batches([parts[0].withColumn("position", F.col("position") * 2), parts[1]])
    empty = [p.where("position < 0") for p in parts]
    assert K.align_batches(empty).count() == 0


# --- reference files ---------------------------------------------------------------------------------------------------

TAXONOMY = {
    "_version": 3, "primary_eval": {"note": "held out", "items": [{"id": "VIEWS", "construct": "ideology", "format": "likert7", "scale_text": "1-7"}, {"id": "TRUST", "construct": "trust", "format": "likert3"}, {"id": "GUNS", "format": "binary"}]},
    "sensitivity_eval": {"items": ["HAPPY"]}, "feature_bins": {"_note": "locked", "demographic": ["AGE", "SEX", "RACE"], "attitudinal": ["NATENVIR", "GUNS", "SEX"]},
}
BATTERIES = {
    "batteries": {"politics": {"bin": "attitudinal", "construct": "c", "items": ["VIEWS", "NATENVIR"]}, "people": {"bin": "demographic", "items": ["AGE", "NATENVIR"]}, "odd": {"items": ["RACE"]}, "lost": {"bin": "attitudinal", "items": ["NOWHERE", "AGE"]}},
    "singletons": ["TRUST", "VIEWS"],
}


def test_reference_files(spark, tmp_path):
    (tmp_path / "tax.json").write_text(json.dumps(TAXONOMY, indent=2))
    (tmp_path / "bat.json").write_text(json.dumps(BATTERIES, indent=2))
    ref = K.reference_tables(spark, str(tmp_path / "tax.json"), str(tmp_path / "bat.json"))
    assert rows(ref.items, "item", "format", "scale_text") == {("VIEWS", "likert7", "1-7"), ("TRUST", "likert3", None), ("GUNS", "binary", None)}
    assert rows(ref.features, "var", "bin") == {("AGE", "demographic"), ("SEX", "demographic"), ("RACE", "demographic"), ("NATENVIR", "attitudinal"), ("GUNS", "attitudinal"), ("SEX", "attitudinal")}
    assert rows(ref.batteries, "battery", "bin", "var") >= {("politics", "attitudinal", "VIEWS"), ("odd", None, "RACE")} and rows(ref.sensitivity, "item") == {("HAPPY",)}
    assert rows(K.battery_exclusions(ref), "item", "var") == {("VIEWS", "VIEWS"), ("VIEWS", "NATENVIR"), ("TRUST", "TRUST"), ("GUNS", "GUNS")}
    data = spark.createDataFrame([(v,) for v in ("VIEWS", "TRUST", "GUNS", "HAPPY", "AGE", "SEX", "NATENVIR")], "var string")
    got = rows(K.reference_violations(ref, data, {"demographic": 1, "attitudinal": 3}), "check", "name", "detail")
    assert got == {
        ("target_is_feature", "GUNS", "attitudinal"), ("several_bins", "SEX", "attitudinal,demographic"), ("several_batteries", "NATENVIR", "people,politics"), ("several_batteries", "AGE", "lost,people"),
        ("battery_and_singleton", "VIEWS", "politics"), ("no_battery", "GUNS", ""), ("battery_without_bin", "odd", ""), ("battery_of_no_bin", "NOWHERE", "lost"), ("battery_of_other_bin", "NATENVIR", "people,demographic,attitudinal"),
        ("battery_of_other_bin", "AGE", "lost,attitudinal,demographic"), ("not_in_data", "RACE", ""), ("not_in_data", "NOWHERE", ""), ("battery_count", "attitudinal", "2 of 3"),
    }
    fine = {"batteries": {"politics": {"bin": "attitudinal", "items": ["VIEWS", "NATENVIR"]}}, "singletons": ["TRUST"]}
    tax = {"primary_eval": {"items": [{"id": "VIEWS"}, {"id": "TRUST"}]}, "sensitivity_eval": {"items": []}, "feature_bins": {"attitudinal": ["NATENVIR"]}}
    (tmp_path / "tax2.json").write_text(json.dumps(tax))
    (tmp_path / "bat2.json").write_text(json.dumps(fine))
    assert K.reference_violations(K.reference_tables(spark, str(tmp_path / "tax2.json"), str(tmp_path / "bat2.json"))).count() == 0


def test_variance_reference_and_uncovered_codes(spark, tmp_path):
    (tmp_path / "var.json").write_text(json.dumps({"_meta": {"n": 1}, "VIEWS": {"n": 3160, "human_variance": 2.34, "dq3_threshold_30pct": 0.702}, "bare": 3, "T": {"n": 5, "variance": 1.5}}))
    assert rows(K.variance_reference(spark, str(tmp_path / "var.json")), "item", "n", "variance", "threshold") == {("VIEWS", 3160, 2.34, 0.702), ("T", 5, 1.5, None)}
    answers = spark.createDataFrame([("A", 1), ("A", 6), ("A", 6), ("A", -99), ("A", None), ("B", 9)], "var string, code int")
    assert rows(K.uncovered_codes(answers, {"A": [1, 2, 3]}), "var", "code", "n") == {("A", 6, 2)}


# --- the stored long table ---------------------------------------------------------------------------------------------


def test_long_table_of_records(spark, tmp_path):
    """Two conditions and two items with a failure, a ballot skip and provenance, through the stored 19 columns and back."""
    ok = {"truth": 2, "persona_code": 3, "parse_fail": False, "treatment": "likert", "abs_err": 1.0, "tokens_in": 900, "tokens_out": 2, "provider": "p", "model_returned": "m-1", "system_fingerprint": "fp", "error_type": "ok"}
    recs = [
        {"respondent_id": 1, "condition": "loo_drop_demographic", "model": "m", "prompt_id": "P1", "per_item_scores": {"A": [ok, {"truth": 2, "parse_fail": True, "treatment": "likert"}], "B": [{"truth": None, "skipped_missing_truth": True}]}},
        {"respondent_id": 2, "condition": "random_battery_drop", "model": "m", "per_item_scores": {"B": [{"truth": 1, "persona_code": 2, "parse_fail": False, "treatment": "categorical", "cat_match": 0, "random_dropped_battery": "voting"}, {"truth": 1, "persona_code": 1}]}},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(r) for r in recs))
    long = M.explode_records(M.records_json(spark, str(tmp_path / "r.json")), {"loo_drop_demographic": "drop_demographic"})
    M.write_long(long, str(tmp_path / "long"), timestamp="2026-01-01T00:00:00Z")
    back = M.read_long(spark, str(tmp_path / "long"))
    assert back.columns == ["respondent_id", "model", "prompt", "condition", "item", "true_code", "pred_code", "parse_ok", "abs_err", "sample_position", "timestamp", "cost_usd", "tokens_in", "tokens_out", "error_type", "provider", "system_fingerprint", "model_returned", "random_dropped_battery"]
    got = {(r["respondent_id"], r["item"], r["sample_position"]): r for r in back.collect()}
    assert set(got) == {(1, "A", 1), (1, "A", 2), (2, "B", 1), (2, "B", 2)}
    a, f, b, c = got[1, "A", 1], got[1, "A", 2], got[2, "B", 1], got[2, "B", 2]
    assert (a["condition"], a["abs_err"], a["tokens_in"], a["provider"], a["timestamp"], a["cost_usd"]) == ("drop_demographic", 1, 900, "p", "2026-01-01T00:00:00Z", None)
    assert (f["parse_ok"], f["pred_code"], f["abs_err"], f["error_type"]) == (False, None, None, "parse_fail")
    assert (b["prompt"], b["abs_err"], b["random_dropped_battery"], b["error_type"]) == ("P0", 1, "voting", "ok")
    assert (c["parse_ok"], c["pred_code"]) == (False, None)  # a sample that does not say that it was parsed counts as a failure
    assert M.append_new(spark, spark.createDataFrame([(1, "x")], "k int, v string"), _stored(spark, tmp_path), ["k"]) == 1 and not list(tmp_path.glob("*.staged*"))


def _stored(spark, tmp_path):
    path = str(tmp_path / "store")
    spark.createDataFrame([(2, "y")], "k int, v string").write.parquet(path)
    return path


# --- ingest ------------------------------------------------------------------------------------------------------------

EVENT = "event_id long, ts timestamp, v string"


def put(spark, folder, number, events):
    spark.createDataFrame(events, "event_id long, ts string, v string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(folder))


def ingest(spark, folder, path, checkpoint, **more):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder))
    H.ingest_into(stream, str(path), str(checkpoint), ["event_id"], **more)
    return sorted((r["event_id"], r["v"]) for r in H.stored(spark, str(path)).collect())


def test_ingest_restarts_as_a_no_op(spark, tmp_path):
    put(spark, tmp_path / "in", 0, [(1, "2026-01-01 00:00:00", "a"), (2, "2026-01-01 00:01:00", "b"), (2, "2026-01-01 00:01:00", "b")])
    assert ingest(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp") == [(1, "a"), (2, "b")]
    files = sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    assert ingest(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp") == [(1, "a"), (2, "b")]
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.parquet")) == files  # nothing was written again
    put(spark, tmp_path / "in", 1, [(2, "2026-01-02 00:00:00", "again"), (3, "2026-01-02 00:00:00", "c"), (None, "2026-01-02 00:00:00", "n")])
    stream = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    H.ingest_into(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"])
    want = {(1, "a"), (2, "b"), (3, "c"), (None, "n")}
    got = H.stored(spark, str(tmp_path / "out"))
    assert {(r["event_id"], r["v"]) for r in got.collect()} == want and got.count() == 4
    # a lost checkpoint: all input comes again and meets the keys of the store
    H.ingest_into(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "new"), ["event_id"])
    got = H.stored(spark, str(tmp_path / "out"))
    assert {(r["event_id"], r["v"]) for r in got.collect()} == want and got.count() == 4


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, "2026-01-01 00:00:00", "b"), (1, "2026-01-01 00:00:00", "a"), (2, "2026-01-01 00:00:00", "x")], "event_id long, ts string, v string").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "out")
    for _ in range(2):
        H.append_batch(rows_, 7, path, ["event_id"])
    assert sorted((r["event_id"], r["v"], r[H.BATCH]) for r in H.stored(spark, path).collect()) == [(1, "a", 7), (2, "x", 7)]
    H.append_batch(rows_.unionByName(rows_.limit(1).withColumn("event_id", F.lit(3).cast("long"))), 8, path, ["event_id"])
    assert sorted((r["event_id"], r[H.BATCH]) for r in H.stored(spark, path).collect()) == [(1, 7), (2, 7), (3, 8)]


def test_keys_beyond_the_watermark_meet_the_store(spark, tmp_path):
    """Streaming state forgets keys after the watermark; a copy that comes later is still stored once."""
    put(spark, tmp_path / "in", 0, [(1, "2026-01-01 00:00:00", "a"), (9, "2026-01-10 00:00:00", "z")])
    one = ingest(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp", ts="ts", late="1 hour")
    assert one == [(1, "a"), (9, "z")]
    put(spark, tmp_path / "in", 1, [(1, "2026-01-20 00:00:00", "late copy"), (5, "2026-01-20 00:00:00", "new"), (6, "2026-01-01 00:00:00", "too late")])
    assert ingest(spark, tmp_path / "in", tmp_path / "out", tmp_path / "cp", ts="ts", late="1 hour") == [(1, "a"), (5, "new"), (9, "z")]
