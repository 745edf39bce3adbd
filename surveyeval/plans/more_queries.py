"""Queries over labels, options and question texts, error columns, whole delta tables and the selection rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import decide as D
from ..operators import questions as Q
from ..operators import tables as T
from ..operators import text as TX
from ..sources import microdata as M
from . import fixtures as FX
from .queries import A, P, panel, pred, query

LABELS = ["Yes", "NA", "n/a", "Refused", "DK", "DK/NA", "uncodable", "not asked", "Not in survey", "IAP: x", "cannot choose", "not available", "skipped work", "skipped on web", "do not know", "No answer given", "", "nothing", "Banana", "inapplicable"]
_LABEL_SQL = f"[{', '.join(repr(x) for x in LABELS)}][c_custkey % {len(LABELS)} + 1]"
_CODE_SQL = "CASE WHEN c_custkey % 7 = 0 THEN -99 WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN -8 ELSE c_nationkey END"
_EMPTY_SQL = "(trim(l) = '' OR lower(trim(l)) IN ('na', 'n/a', 'n.a.', 'dk', 'dk/na', 'na/dk') OR " + " OR ".join(f"contains(lower(l), '{x.replace(chr(39), chr(39) * 2)}')" for x in S.EMPTY_PARTS) + ")"
_MISSING_SQL = f"(code IS NULL OR code IN ({', '.join(map(str, S.MISSING_CODES))}))"
_CODED = f"WITH coded AS (SELECT c_custkey AS rid, {_CODE_SQL} AS code, {_LABEL_SQL} AS l FROM customer)"


def _coded(spark: SparkSession, d: str) -> DataFrame:
    rid = F.col("c_custkey")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (rid % len(LABELS) + 1).cast("int"))
    code = F.when(rid % 7 == 0, -99).when(rid % 11 == 0, None).when(rid % 13 == 0, -8).otherwise(F.col("c_nationkey")).cast("long")
    return spark.read.parquet(f"{d}/customer.parquet").select(rid.cast("long").alias("rid"), code.alias("code"), label.alias("l"))


@query("fn_is_missing", f"{_CODED} SELECT rid, {_MISSING_SQL} AS missing FROM coded")
def _(spark, d):
    return _coded(spark, d).select("rid", S.is_missing(F.col("code")).alias("missing"))


@query("fn_non_substantive", f"{_CODED} SELECT rid, l, {_EMPTY_SQL} AS empty FROM coded")
def _(spark, d):
    return _coded(spark, d).select("rid", "l", S.non_substantive(F.col("l")).alias("empty"))


@query("fn_truth_code", f"{_CODED} SELECT rid, CASE WHEN NOT {_MISSING_SQL} AND NOT {_EMPTY_SQL} THEN code END AS truth FROM coded")
def _(spark, d):
    return _coded(spark, d).select("rid", S.truth_code(F.col("code"), F.col("l")).alias("truth"))


_KIND = "CASE WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR coalesce(pred_code = 7, FALSE))) OR fmt = 'categorical' THEN 'categorical' ELSE 'likert' END"


@query("fn_treatment", f"{P} SELECT rid, item, condition, {_KIND} AS treatment FROM p")
def _(spark, d):
    return pred(spark, d).select("rid", "item", "condition", S.treatment(F.col("fmt"), F.col("true_code"), F.col("pred_code")).alias("treatment"))


@query("fn_unify_abs_err", f"{P} SELECT rid, item, condition, CASE WHEN parse_ok THEN CASE WHEN k = 'likert' THEN CAST(abs_err AS DOUBLE) ELSE CAST(true_code <> pred_code AS BIGINT) END END AS err FROM (SELECT *, {_KIND} AS k FROM p) q")
def _(spark, d):
    df = pred(spark, d).withColumn("k", S.treatment(F.col("fmt"), F.col("true_code"), F.col("pred_code")))
    return df.select("rid", "item", "condition", S.unified_error(F.col("k"), F.col("abs_err"), (F.col("true_code") == F.col("pred_code")).cast("double"), F.col("parse_ok")).alias("err"))


@query("fn_effect_label", """SELECT c_custkey AS rid, CASE WHEN x < 0.02 THEN 'small' WHEN x < 0.05 THEN 'modest' ELSE 'substantive' END AS effect, c_custkey % 2 = 0 AND x >= 0.02 AND x - CAST(0.01 AS DOUBLE) > CAST(0.02 AS DOUBLE) AS flag,
 round(CASE WHEN x < 1 THEN (x - 0.1) / 0.9 END, 6) AS lift, round(greatest(CASE WHEN c_custkey % 3 > 0 THEN x / 100 ELSE 0 END, CAST(0.00005 AS DOUBLE)) * (1 + x), 9) AS cost FROM (SELECT c_custkey, CAST(c_custkey % 200 - 100 AS DOUBLE) / 1000 AS x FROM customer) q""")
def _(spark, d):
    """Effect label, flag, lift over a base of 0.1 and cost score of made-up deltas of every sign."""
    x = (F.col("c_custkey") % 200 - 100).cast("double") / 1000
    df = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"), x.alias("x"))
    label = S.effect_label(F.col("x"))
    flag = S.substantive_flag(F.col("rid") % 2 == 0, label, F.col("x") - 0.01)
    cost = S.cost_score(F.when(F.col("rid") % 3 > 0, F.col("x") / 100), F.col("x"))
    return df.select("rid", label.alias("effect"), flag.alias("flag"), F.round(S.lift(F.col("x"), F.lit(0.1)), 6).alias("lift"), F.round(cost, 9).alias("cost"))


# Variables and labels of a small codebook; its codes are counted in the answers.
_VARS = [("SEGMENT", "market segment"), ("NATION", "nation of residence")]
_CODES = [(1, "Automobile"), (2, "Building"), (3, "Furniture"), (4, "Household"), (5, "Machinery"), (6, "Refused"), (-99, "No answer"), (-3, "Below zero")]
_STEMS = [("NATION", "Where do you live?")]
_ANSWERS = "answers AS (SELECT c_custkey AS rid, 'segment' AS var, CASE WHEN c_custkey % 17 = 0 THEN -99 ELSE c_nationkey % 9 END AS code FROM customer UNION ALL SELECT c_custkey, 'other', c_nationkey FROM customer WHERE c_custkey % 5 = 0)"
_BOOK = f"vars(var, label) AS (VALUES {', '.join(f'({v!r}, {x!r})' for v, x in _VARS)}), codes(code, label) AS (VALUES {', '.join(f'({c}, {x!r})' for c, x in _CODES)})"


def _book(spark: SparkSession, d: str):
    c = spark.read.parquet(f"{d}/customer.parquet")
    rid, nation = F.col("c_custkey").cast("long"), F.col("c_nationkey").cast("long")
    one = c.select(rid.alias("rid"), F.lit("segment").alias("var"), F.when(rid % 17 == 0, -99).otherwise(nation % 9).cast("long").alias("code"))
    answers = one.unionByName(c.where(rid % 5 == 0).select(rid.alias("rid"), F.lit("other").alias("var"), nation.alias("code")))
    labels = spark.createDataFrame([("SEGMENT", n, x) for n, x in _CODES], "var string, code long, label string")
    return answers, spark.createDataFrame(_VARS, "var string, label string"), labels


@query("fn_variable_label", f"WITH {_BOOK}, {_ANSWERS} SELECT a.var, coalesce(v.label, a.var) AS variable_label, count(*) AS n FROM answers a LEFT JOIN vars v ON v.var = upper(a.var) GROUP BY 1, 2")
def _(spark, d):
    answers, variables, _ = _book(spark, d)
    return Q.with_variable_label(answers, variables).groupBy("var", "variable_label").agg(F.count("*").alias("n"))


@query("fn_value_label", f"WITH {_BOOK}, {_ANSWERS} SELECT rid, a.var, a.code, CASE WHEN a.code NOT IN ({', '.join(map(str, S.MISSING_CODES))}) THEN coalesce(c.label, CAST(a.code AS VARCHAR)) END AS value_label FROM answers a LEFT JOIN codes c ON c.code = a.code AND a.var = 'segment'")
def _(spark, d):
    answers, _, labels = _book(spark, d)
    return Q.with_value_label(answers, labels).select("rid", "var", "code", "value_label")


@query("fn_scale_options", f"WITH {_BOOK}, {_ANSWERS} SELECT c.code, c.label, count(rid) AS n FROM codes c LEFT JOIN answers a ON a.code = c.code AND a.var = 'segment' WHERE c.code >= 0 AND lower(c.label) <> 'refused' GROUP BY 1, 2")
def _(spark, d):
    """The valid options of a variable, and how many answers take each."""
    answers, _, labels = _book(spark, d)
    options = Q.scale_options(labels).select(F.explode("options").alias("o")).select("o.code", "o.label")
    counts = answers.where("var = 'segment'").groupBy("code").agg(F.count("*").alias("n"))
    return options.join(counts, "code", "left").select("code", "label", F.coalesce("n", F.lit(0)).alias("n"))


_SPARSE_SQL = "CASE WHEN var = 'HAPPY' THEN 'Output ONLY a single integer code from ' || lo || ' to ' || hi || '. Codes between the labeled anchors above (e.g. 2 and 4) are valid intermediate positions; pick whichever single integer best matches this person''s view.' ELSE 'Output ONLY a single integer code (' || lo || '-' || hi || ').' END"


@query("fn_question_text", f"""WITH {FX.TRUTH_SQL}, seen AS (SELECT item AS var, true_code AS code, 'answer ' || CAST(true_code AS VARCHAR) AS label FROM truth GROUP BY item, true_code),
 o AS (SELECT var, min(code) AS lo, max(code) AS hi, string_agg('  ' || code || '. ' || label, chr(10) ORDER BY code) AS lines FROM seen GROUP BY var)
 SELECT var, 'Survey question: ' || CASE var WHEN 'VIEWS' THEN 'Where do you stand?' WHEN 'PARTY' THEN 'party identification' ELSE var END || chr(10) || chr(10) || 'Options:' || chr(10) || lines || chr(10) || chr(10) || {_SPARSE_SQL} AS question, hi - lo + 1 AS n_valid FROM o""")
def _(spark, d):
    """Question texts of all items from the codes their answers take."""
    labels = FX.truth(spark, d).groupBy(F.col("item").alias("var"), F.col("true_code").alias("code")).agg(F.count("*").alias("n")).select("var", "code", F.concat(F.lit("answer "), F.col("code").cast("string")).alias("label"))
    variables = spark.createDataFrame([("PARTY", "party identification"), ("VIEWS", "views")], "var string, label string")
    stems = spark.createDataFrame([("VIEWS", "Where do you stand?")], "var string, stem string")
    return Q.question_text(Q.scale_options(labels), variables, stems, ["HAPPY"]).select("var", "question", F.size("valid_codes").cast("long").alias("n_valid"))


@query("fn_item_format", f"WITH {FX.ITEMS_SQL} SELECT item, n_options, CASE WHEN item = 'PARTY' THEN 'contingent' WHEN n_options = 2 THEN 'binary' WHEN n_options IN (3, 4, 5, 7) THEN 'likert' || n_options ELSE 'categorical' END AS format FROM (SELECT item, count(DISTINCT true_code) AS n_options FROM (WITH {FX.TRUTH_SQL} SELECT * FROM truth) t GROUP BY item) q")
def _(spark, d):
    n = FX.truth(spark, d).groupBy("item").agg(F.countDistinct("true_code").alias("n_options"))
    return Q.with_format(n, {"PARTY": "contingent"})


_RECORDS = "people AS (SELECT c_custkey AS rid, c_nationkey AS n FROM customer)"


@query("jn_explode_records", f"WITH {_RECORDS} SELECT rid, item, sample, true_code, CASE WHEN ok THEN pred_code END AS pred_code, ok AS parse_ok FROM (SELECT rid, 'A' AS item, 1 AS sample, CASE WHEN rid % 5 > 0 THEN n END AS true_code, n + 1 AS pred_code, rid % 3 > 0 AS ok FROM people UNION ALL SELECT rid, 'A', 2, n, n, TRUE FROM people UNION ALL SELECT rid, 'B', 1, 2, 3, TRUE FROM people) q WHERE true_code IS NOT NULL")
def _(spark, d):
    """Nested records built from customers: item A with two samples (some without a truth), item B with one."""
    n, rid = F.col("c_nationkey").cast("int"), F.col("c_custkey").cast("int")
    one = lambda truth, code, fail: F.struct(truth.alias("truth"), F.lit("x").alias("persona_raw"), code.alias("persona_code"), fail.alias("parse_fail"), F.lit("likert").alias("treatment"), F.lit(1.0).alias("abs_err"), F.lit(0).alias("cat_match"), F.lit(False).alias("skipped_missing_truth"), F.lit("ok").alias("error_type"))
    a = F.array(one(F.when(rid % 5 > 0, n), n + 1, rid % 3 == 0), one(n, n, F.lit(False)))
    b = F.array(one(F.lit(2), F.lit(3), F.lit(False)))
    records = spark.read.parquet(f"{d}/customer.parquet").select(rid.alias("respondent_id"), F.lit("full").alias("condition"), F.lit("m").alias("model"), F.lit("P1").alias("prompt_id"), F.create_map(F.lit("A"), a, F.lit("B"), b).alias("per_item_scores"))
    return M.explode_records(records).select(F.col("rid").cast("long").alias("rid"), "item", F.col("sample").cast("int").alias("sample"), "true_code", "pred_code", "parse_ok")


_MATCH = "CASE k WHEN 0 THEN lower(s) WHEN 1 THEN 'I say  ' || s || '!' WHEN 2 THEN 'Building' WHEN 3 THEN 'mostly ' || lower(substr(s, 1, 4)) WHEN 4 THEN ' ' ELSE 'the ' || s || ' trade' END"


@query("txt_option_match", f"""WITH a AS (SELECT c_custkey AS rid, c_mktsegment AS s, c_custkey % 6 AS k FROM customer), b AS (SELECT rid, lower(trim(regexp_replace({_MATCH}, '\\s+', ' ', 'g'))) AS p, lower(substr(s, 1, 4) || ' sector, ' || s || ' / other') AS t, s FROM a)
 SELECT rid, p <> '' AND (contains(p, t) OR contains(t, p) OR len(list_filter(regexp_split_to_array(t, '[,/]'), lambda f: trim(f) <> '' AND contains(p, trim(f)))) > 0) AS match, p <> '' AND (starts_with(p, lower(s)) OR starts_with(lower(s), p) OR len(list_filter(['building', 'machinery'], lambda o: contains(p, o) AND contains(lower(s), o))) > 0) AS shared FROM b""")
def _(spark, d):
    """Answers that repeat, hold or shorten the truth or a fragment of it, name one segment always, or are empty; and with a closed list of options."""
    seg, k = F.col("c_mktsegment"), F.col("c_custkey") % 6
    said = F.when(k == 0, F.lower(seg)).when(k == 1, F.concat(F.lit("I say  "), seg, F.lit("!"))).when(k == 2, "Building").when(k == 3, F.concat(F.lit("mostly "), F.lower(F.substring(seg, 1, 4)))).when(k == 4, " ").otherwise(F.concat(F.lit("the "), seg, F.lit(" trade")))
    truth = F.concat(F.substring(seg, 1, 4), F.lit(" sector, "), seg, F.lit(" / other"))
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"), TX.option_match(said, truth).alias("match"), TX.option_match(said, seg, ["Building", "machinery"]).alias("shared"))


@query("txt_utterances", r"""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Respondent' ELSE 'Interviewer' END AS role, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS words FROM conversations WHERE turn IS NOT NULL),
 d AS (SELECT conv_id, turn, role, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, words) AS n FROM t) SELECT conv_id AS doc_id, n, role, words AS utterance FROM d""")
def _(spark, d):
    """Transcripts made of conversations (a label before each turn), cut back into utterances."""
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    role = F.when(F.col("role") == "user", "Respondent").otherwise("Interviewer")
    turns = spark.read.parquet(f"{d}/conversations.parquet").where("turn is not null").select("conv_id", F.struct("turn", role.alias("role"), words.alias("words")).alias("t"))
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.concat(t["role"], F.lit(": "), t["words"])), "\n").alias("text"))
    return TX.utterances(docs)


_DELTAS = f"{P}, cells AS (SELECT rid, condition, model, err FROM p UNION ALL SELECT rid, condition, 'combined', err FROM p), m AS (SELECT rid, model AS col, condition, avg(err) AS m FROM cells GROUP BY rid, model, condition), dl AS (SELECT x.rid, x.col, x.condition, x.m - f.m AS delta FROM m x JOIN m f ON f.rid = x.rid AND f.col = x.col AND f.condition = 'Full' WHERE x.condition LIKE 'drop_%')"


@query("ag_t2_bin_columns", f'{_DELTAS} SELECT condition, col AS "column", round(avg(delta), 6) AS delta, count(*) AS n FROM dl GROUP BY condition, col')
def _(spark, d):
    return T.bin_columns(pred(spark, d))


@query("ag_t2_bin_intervals")
def _(spark, d):
    return T.bin_intervals(pred(spark, d))


_PAIRS = f"{P}, pr AS (SELECT b.rid, b.item, b.battery_no, unnest([b.model, 'combined']) AS col, b.err - a.err AS delta FROM p a JOIN p b ON a.rid = b.rid AND a.item = b.item AND a.condition = 'Full' AND b.condition = 'random_battery_drop' WHERE a.parse_ok AND b.parse_ok)"


@query("ag_t3_battery_columns", f"""{_PAIRS}, g AS (SELECT battery, col, round(avg(delta), 6) AS delta, count(*) AS n_pairs, count(DISTINCT rid) AS n_respondents, count(DISTINCT item) AS n_items FROM pr JOIN batteries USING (battery_no) GROUP BY battery, col),
 k AS (SELECT battery, row_number() OVER (ORDER BY delta DESC, battery) AS rank FROM g WHERE col = 'combined') SELECT g.battery, col AS "column", delta, n_pairs, n_respondents, n_items, rank FROM g JOIN k USING (battery)""")
def _(spark, d):
    return T.battery_columns(pred(spark, d), FX.batteries(spark))


@query("ag_t3_battery_intervals")
def _(spark, d):
    return T.battery_intervals(pred(spark, d), FX.batteries(spark))


@query("ag_headline_intervals")
def _(spark, d):
    return T.headline_intervals(pred(spark, d))


@query("ag_condition_metrics", f"""{P}, x AS (SELECT condition, rid, item, unnest([{{'metric': 'likert_mae', 'v': CASE WHEN k = 'likert' THEN CAST(abs_err AS DOUBLE) END}}, {{'metric': 'within1', 'v': CASE WHEN k = 'likert' THEN CAST(CAST(abs_err <= 1 AS BIGINT) AS DOUBLE) END}}, {{'metric': 'cat_match', 'v': CASE WHEN k = 'categorical' THEN CAST(CAST(abs_err = 0 AS BIGINT) AS DOUBLE) END}}]) AS s FROM (SELECT *, {_KIND} AS k FROM p WHERE parse_ok) q),
 y AS (SELECT condition, rid, item, s.metric AS metric, s.v AS v FROM x WHERE s.v IS NOT NULL),
 a AS (SELECT condition, metric, round(avg(m), 6) AS respondent_macro FROM (SELECT condition, metric, rid, avg(v) AS m FROM y GROUP BY ALL) q GROUP BY ALL), b AS (SELECT condition, metric, round(avg(m), 6) AS item_macro FROM (SELECT condition, metric, item, avg(v) AS m FROM y GROUP BY ALL) q GROUP BY ALL)
 SELECT condition, metric, respondent_macro, item_macro, round(avg(v), 6) AS pooled, count(*) AS n FROM y JOIN a USING (condition, metric) JOIN b USING (condition, metric) GROUP BY ALL""")
def _(spark, d):
    return T.condition_metrics(pred(spark, d))


_FALLBACK = (FX.MODELS[0], "P1")
_COST = {m: 0.0001 * (i + 1) for i, m in enumerate(FX.MODELS)}


@query("sel_rule", f"""{A}, c AS (SELECT model, prompt, round(avg(m), 6) AS macro FROM (SELECT model, prompt, rid, avg(err) AS m FROM p GROUP BY ALL) q GROUP BY ALL), f AS (SELECT model, prompt, round(1 - avg(CASE WHEN parse_ok THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS pf FROM p GROUP BY ALL),
 j AS (SELECT model, prompt, macro, macro - CAST(0.002 AS DOUBLE) AS lo, macro + CAST(0.002 AS DOUBLE) AS hi, (list_position(['cheap_a', 'cheap_b', 'cheap_c', 'cheap_d'], model)) * CAST(0.0001 AS DOUBLE) * (1 + pf) AS cost, pf <= 0.10 AS ok FROM c JOIN f USING (model, prompt)),
 b AS (SELECT * FROM j WHERE ok ORDER BY macro, model, prompt LIMIT 1), t AS (SELECT j.*, j.ok AND greatest(j.lo, b.lo) <= least(j.hi, b.hi) AS tied, j.model = b.model AND j.prompt = b.prompt AS best FROM j, b),
 z AS (SELECT *, tied AND cost <= (SELECT min(cost) FROM t WHERE tied) * 1.01 AS cost_tied FROM t)
 SELECT model, prompt, macro, best, tied, cost_tied, CASE WHEN (SELECT count(*) FROM z WHERE tied) = 1 THEN best WHEN (SELECT count(*) FROM z WHERE cost_tied) = 1 THEN cost_tied ELSE model = 'cheap_a' AND prompt = 'P1' END AS chosen FROM z""")
def _(spark, d):
    """The tie rule on intervals of a fixed half-width, so that the outcome can be compared."""
    df = panel(spark, d)
    rate = df.groupBy("model", "prompt").agg(T.r6(1 - F.avg(F.col("parse_ok").cast("double"))).alias("pf"))
    place = F.array_position(F.array(*map(F.lit, FX.MODELS)), F.col("model"))
    cells = T.respondent_macro(df, ["model", "prompt"]).join(rate, ["model", "prompt"]).select("model", "prompt", "macro", (F.col("macro") - 0.002).alias("lo"), (F.col("macro") + 0.002).alias("hi"), (place * 0.0001 * (1 + F.col("pf"))).alias("cost_score"), (F.col("pf") <= 0.10).alias("survives"))
    return D.apply_rule(cells, _FALLBACK).select("model", "prompt", "macro", "best", "tied", "cost_tied", "chosen")


@query("sel_joint_cell_rule")
def _(spark, d):
    """The whole selection with bootstrap intervals and the Random column."""
    return D.select_cell(panel(spark, d), T.human_variance(FX.truth(spark, d)), _COST, _FALLBACK)
