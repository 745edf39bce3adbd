"""Queries over the derived survey tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import cohorts as C
from ..operators import decide as D
from ..operators import sets as X
from ..operators import stats as ST
from ..operators import tables as T
from ..operators import text as TX
from . import fixtures as FX

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def steady(sql: str) -> str:
    """round(x, 6) in SQL as `tables.r6` rounds: through decimals of 12 places, so exact halves go up whatever the order of a sum."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i = 1, start + len("round(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inside = sql[start + len("round(") : i - 1]
        out.append(sql[at:start])
        out.append(f"CAST(round(CAST({steady(inside[:-3])} AS DECIMAL(38, 12)), 6) AS DOUBLE)" if inside.endswith(", 6") else f"round({steady(inside)})")
        at = i
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None):
    def put(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = steady(sql.strip())
        return f

    return put


def pred(spark: SparkSession, d: str) -> DataFrame:
    return T.scored(FX.predictions(spark, d))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return T.scored(FX.panel(spark, d))


_ERR = "CASE WHEN parse_ok THEN CAST(abs_err AS DOUBLE) / (hi - lo) ELSE 1.0 END"
_EX0 = "CASE WHEN parse_ok AND true_code = pred_code THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
P = f"WITH {FX.PRED_SQL}, p AS (SELECT *, {_ERR} AS err, {_EX0} AS exact0 FROM pred)"
A = f"WITH {FX.PANEL_SQL}, p AS (SELECT *, {_ERR} AS err, {_EX0} AS exact0 FROM panel)"
TR = f"WITH {FX.TRUTH_SQL}"
_HEX = lambda payload, n: f"CAST(CAST('0x' || substr(sha256({payload}), 1, 16) AS UBIGINT) % {n} AS BIGINT)"

# --- functions ---------------------------------------------------------------------------------------------------------


@query("fn_normalized_error", f"{P} SELECT rid, item, condition, round(err, 6) AS err, round(CASE WHEN parse_ok THEN err END, 6) AS err_opt FROM p")
def _(spark, d):
    return pred(spark, d).select("rid", "item", "condition", T.r6("err").alias("err"), T.r6("err_opt").alias("err_opt"))


@query("fn_score_item", f"""{P} SELECT rid, item, condition, treatment, abs_err, NOT parse_ok AS parse_fail,
 CASE WHEN parse_ok AND treatment = 'likert' THEN CAST(abs_err <= 1 AS BIGINT) END AS within1, CASE WHEN parse_ok AND treatment = 'categorical' THEN CAST(abs_err = 0 AS BIGINT) END AS cat_match
 FROM (SELECT *, CASE WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR coalesce(pred_code = 7, FALSE))) THEN 'categorical' ELSE 'likert' END AS treatment FROM p) q""")
def _(spark, d):
    df = pred(spark, d).withColumn("treatment", S.treatment(F.col("fmt"), F.col("true_code"), F.col("pred_code")))
    ok = F.col("parse_ok")
    return df.select("rid", "item", "condition", "treatment", "abs_err", (~ok).alias("parse_fail"), F.when(ok & (F.col("treatment") == "likert"), (F.col("abs_err") <= 1).cast("long")).alias("within1"), F.when(ok & (F.col("treatment") == "categorical"), (F.col("abs_err") == 0).cast("long")).alias("cat_match"))


@query("fn_exact_match", f"{P} SELECT item, condition, CAST(sum(exact0) AS BIGINT) AS n_exact, round(avg(exact0), 6) AS all_rows, round(avg(CASE WHEN parse_ok THEN exact0 END), 6) AS parsed_rows FROM p GROUP BY item, condition")
def _(spark, d):
    return pred(spark, d).groupBy("item", "condition").agg(F.sum("exact0").cast("long").alias("n_exact"), T.r6(F.avg("exact0")).alias("all_rows"), T.r6(F.avg("exact")).alias("parsed_rows"))


@query("fn_parse_response", f"""{P} SELECT rid, item, condition, CASE WHEN code BETWEEN lo AND hi THEN code END AS code FROM (
 SELECT *, TRY_CAST(regexp_extract(CASE WHEN parse_ok THEN 'I would say ' || CAST(pred_code + CASE WHEN rid % 11 = 0 THEN 9 ELSE 0 END AS VARCHAR) || '. Moderate' ELSE 'no idea' END, '(-?\\d+)', 1) AS BIGINT) AS code FROM p) q""")
def _(spark, d):
    raw = F.when(F.col("parse_ok"), F.concat(F.lit("I would say "), (F.col("pred_code") + F.when(F.col("rid") % 11 == 0, 9).otherwise(0)).cast("string"), F.lit(". Moderate"))).otherwise("no idea")
    return pred(spark, d).select("rid", "item", "condition", S.parse_response(raw, F.sequence("lo", "hi")).alias("code"))


@query("fn_hash_pick_model", f"SELECT c_custkey AS rid, {_HEX(chr(39) + '42|' + chr(39) + ' || CAST(c_custkey AS VARCHAR) || ' + chr(39) + '|P1' + chr(39), 4)} AS pick FROM customer")
def _(spark, d):
    rid = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"))
    return rid.select("rid", S.hash_pick(F.concat_ws("|", F.lit("42"), F.col("rid").cast("string"), F.lit("P1")), F.lit(4)).alias("pick"))


@query("fn_hash_pick_battery", f"""{TR} SELECT rid, item, pick + CASE WHEN item_no % 2 = 0 AND pick >= item_no % 8 THEN 1 ELSE 0 END AS battery_no FROM (
 SELECT *, CAST(CAST('0x' || substr(sha256('42|battery|' || CAST(rid AS VARCHAR) || '|' || item), 1, 16) AS UBIGINT) % (CASE WHEN item_no % 2 = 0 THEN 7 ELSE 8 END) AS BIGINT) AS pick FROM truth) q""")
def _(spark, d):
    even = F.col("item_no") % 2 == 0
    options = F.array_except(F.sequence(F.lit(0), F.lit(7)), F.when(even, F.array((F.col("item_no") % 8).cast("int"))).otherwise(F.array().cast("array<int>")))
    pick = S.hash_pick(F.concat_ws("|", F.lit("42"), F.lit("battery"), F.col("rid").cast("string"), F.col("item")), F.size(options))
    return FX.truth(spark, d).select("rid", "item", F.element_at(options, (pick + 1).cast("int")).cast("long").alias("battery_no"))


@query("fn_call_seed", f"{TR} SELECT rid, item, CAST(CAST('0x' || substr(sha256('42|' || CAST(rid AS VARCHAR) || '|' || item || '|Full|P1|cheap_a|1'), 1, 8) AS UBIGINT) & 2147483647 AS BIGINT) AS seed FROM truth")
def _(spark, d):
    return FX.truth(spark, d).select("rid", "item", S.call_seed(F.lit(42), F.col("rid"), F.col("item"), F.lit("Full"), F.lit("P1"), F.lit("cheap_a"), F.lit(1)).alias("seed"))


@query("fn_relabel", f"{P} SELECT CASE condition WHEN 'Full' THEN 'full' WHEN 'random_battery_drop' THEN 'random' ELSE condition END AS condition, count(*) AS n FROM p GROUP BY 1")
def _(spark, d):
    return pred(spark, d).groupBy(S.relabel(F.col("condition"), {"Full": "full", "random_battery_drop": "random"}).alias("condition")).agg(F.count("*").alias("n"))


@query("fn_clean_label", "SELECT c_custkey AS rid, upper(substr(s, 1, 1)) || lower(substr(s, 2)) AS label FROM (SELECT c_custkey, c_mktsegment AS s FROM customer) q")
def _(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet")
    return df.select(F.col("c_custkey").alias("rid"), S.clean_label(F.concat("c_mktsegment", F.lit(" (specify)"))).alias("label"))


@query("fn_valid_codes", f"WITH {FX.ITEMS_SQL} SELECT item, lo, hi, hi - lo + 1 AS k, hi - lo AS span, CASE WHEN hi - lo + 1 = 2 THEN 'binary' WHEN hi - lo + 1 IN (3, 4, 5, 7) THEN 'likert' || CAST(hi - lo + 1 AS VARCHAR) ELSE 'categorical' END AS fmt, observed FROM items JOIN (SELECT item AS i, count(DISTINCT true_code) AS observed FROM (SELECT * FROM (WITH {FX.TRUTH_SQL} SELECT * FROM truth) t) u GROUP BY item) o ON o.i = item")
def _(spark, d):
    t = FX.truth(spark, d).groupBy("item", "lo", "hi").agg(F.countDistinct("true_code").alias("observed"))
    k = F.size(F.sequence("lo", "hi"))
    return t.select("item", "lo", "hi", k.cast("long").alias("k"), (F.col("hi") - F.col("lo")).alias("span"), S.item_format(k).alias("fmt"), "observed")


@query("fn_error_type", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'provider_error' WHEN event_type <> 'signup' THEN 'ok' ELSE 'parse_fail' END AS kind FROM events")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.error_type(F.col("event_type") != "signup", F.col("event_type") == "error").alias("kind"))


# --- cohorts -----------------------------------------------------------------------------------------------------------


@query("smp_respondents", "SELECT c_custkey AS rid FROM customer ORDER BY sha256('42|' || CAST(c_custkey AS VARCHAR)) LIMIT 100")
def _(spark, d):
    return C.sample_respondents(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid")), 100)


@query("smp_exclude_cohort", f"{P} SELECT condition, count(DISTINCT rid) AS n FROM p WHERE rid NOT IN (SELECT c_custkey FROM customer ORDER BY sha256('42|' || CAST(c_custkey AS VARCHAR)) LIMIT 100) GROUP BY condition")
def _(spark, d):
    df = FX.predictions(spark, d)
    cohort = C.sample_respondents(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid")), 100)
    return C.exclude_cohort(df, cohort).groupBy("condition").agg(F.countDistinct("rid").alias("n"))


@query("smp_first_n", "SELECT user_id AS rid, min(event_id) AS first_seen, row_number() OVER (ORDER BY min(event_id), user_id) AS rank FROM events WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY first_seen, rid LIMIT 50")
def _(spark, d):
    return C.first_n(spark.read.parquet(f"{d}/events.parquet").where("user_id is not null").select(F.col("user_id").alias("rid"), "event_id"), 50, "event_id")


_UNIT = "CAST(CAST('0x' || substr(sha256('42|' || CAST({0} AS VARCHAR)), 1, 8) AS UBIGINT) AS BIGINT)"


@query("smp_split", f"SELECT c_custkey AS rid, CASE WHEN {_UNIT.format('c_custkey')} < {2**31} THEN 'train' ELSE 'test' END AS part FROM customer")
def _(spark, d):
    return C.split(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid")), 0.5)


@query("smp_kfold", f"SELECT c_custkey AS rid, {_UNIT.format('c_custkey')} % 5 AS fold FROM customer")
def _(spark, d):
    return C.folds(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid")), 5)


# --- joins -------------------------------------------------------------------------------------------------------------
_MEANS = f"{P}, m AS (SELECT rid, condition, avg(err) AS m FROM p GROUP BY rid, condition), pairs AS (SELECT a.rid, b.condition, a.m AS base, b.m AS other, b.m - a.m AS delta FROM m a JOIN m b ON a.rid = b.rid AND a.condition = 'Full' AND b.condition <> 'Full')"
_ABL = f"{P}, ab AS (SELECT a.rid, a.item, a.battery_no, b.err AS base, a.err AS other FROM p a JOIN p b ON a.rid = b.rid AND a.item = b.item AND a.condition = 'random_battery_drop' AND b.condition = 'Full' AND a.parse_ok AND b.parse_ok)"


@query("jn_pair_conditions", f"{_MEANS} SELECT rid, condition, round(base, 6) AS base, round(other, 6) AS other, round(delta, 6) AS delta FROM pairs")
def _(spark, d):
    return T.pair_conditions(pred(spark, d)).select("rid", "condition", *[T.r6(c).alias(c) for c in ("base", "other", "delta")])


@query("jn_pair_ablation", f"{_ABL} SELECT rid, item, battery_no, round(base, 6) AS base, round(other, 6) AS other FROM ab")
def _(spark, d):
    return T.pair_ablation(pred(spark, d)).select("rid", "item", "battery_no", T.r6("base").alias("base"), T.r6("other").alias("other"))


_RANDOM = f"p.model = ['cheap_a', 'cheap_b', 'cheap_c', 'cheap_d'][{_HEX(chr(39) + '42|' + chr(39) + ' || CAST(rid AS VARCHAR) || ' + chr(39) + '|' + chr(39) + ' || prompt', 4)} + 1]"


@query("jn_random_column", f"{A} SELECT rid, prompt, item, CAST(sample AS BIGINT) AS sample, 'Random' AS model, pred_code FROM p WHERE {_RANDOM}")
def _(spark, d):
    return T.random_column(FX.panel(spark, d), FX.MODELS).select("rid", "prompt", "item", "sample", "model", "pred_code")


@query("jn_baseline_compare", f"""{P}, k AS (SELECT item, true_code, count(*) AS n FROM truth GROUP BY item, true_code), md AS (SELECT item, min(true_code) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY item) AS m FROM k) q WHERE n = m GROUP BY item),
 b AS (SELECT t.item, avg(CASE WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR mode = 7)) THEN CAST(mode <> true_code AS BIGINT) ELSE abs(mode - true_code) END / CAST(hi - lo AS DOUBLE)) AS base FROM truth t JOIN md ON md.item = t.item GROUP BY t.item)
 SELECT b.item, round(m.err, 6) AS err, round(base, 6) AS baseline, round(base - m.err, 6) AS gain FROM b FULL JOIN (SELECT item, avg(err) AS err FROM p WHERE condition = 'Full' GROUP BY item) m ON m.item = b.item""")
def _(spark, d):
    t = FX.truth(spark, d)
    rows = t.join(F.broadcast(T.majority(t).select("item", "mode")), "item")
    nominal = (F.col("fmt") == "binary") | ((F.col("fmt") == "contingent") & ((F.col("true_code") == 7) | (F.col("mode") == 7)))
    e = F.when(nominal, (F.col("mode") != F.col("true_code")).cast("double")).otherwise(F.abs(F.col("mode") - F.col("true_code")).cast("double")) / (F.col("hi") - F.col("lo"))
    base = rows.groupBy("item").agg(F.avg(e).alias("b"))
    model = pred(spark, d).where("condition = 'Full'").groupBy("item").agg(F.avg("err").alias("e"))
    return base.join(model, "item", "full").select("item", T.r6("e").alias("err"), T.r6("b").alias("baseline"), T.r6(F.col("b") - F.col("e")).alias("gain"))


@query("jn_cost", f"{A} SELECT model, count(*) AS calls, round(count(*) * CASE model WHEN 'cheap_a' THEN 0.0001 WHEN 'cheap_b' THEN 0.0002 WHEN 'cheap_c' THEN 0.0004 ELSE 0.0 END * 1.0, 6) AS cost, round(greatest(CASE model WHEN 'cheap_a' THEN 0.0001 WHEN 'cheap_b' THEN 0.0002 WHEN 'cheap_c' THEN 0.0004 ELSE 0.0 END, 0.00005) * (1 + avg(CASE WHEN parse_ok THEN 0.0 ELSE 1.0 END)), 8) AS score FROM p GROUP BY model".replace("0.0001 ", "CAST(0.0001 AS DOUBLE) ").replace("0.0002 ", "CAST(0.0002 AS DOUBLE) ").replace("0.0004 ", "CAST(0.0004 AS DOUBLE) "))
def _(spark, d):
    rates = spark.createDataFrame([("cheap_a", 0.0001), ("cheap_b", 0.0002), ("cheap_c", 0.0004)], "model string, rate double")
    n = panel(spark, d).groupBy("model").agg(F.count("*").alias("calls"), F.avg((~F.col("parse_ok")).cast("double")).alias("pf")).join(F.broadcast(rates), "model", "left")
    return n.select("model", "calls", T.r6(F.col("calls") * F.coalesce("rate", F.lit(0.0))).alias("cost"), F.round(S.cost_score(F.col("rate"), F.col("pf")), 8).alias("score"))


@query("jn_common_respondents", f"{P}, ok AS (SELECT rid FROM p WHERE parse_ok GROUP BY rid HAVING count(DISTINCT condition) = 6 AND count(*) = max(CASE WHEN condition = 'Full' THEN 1 END) * 48) SELECT p.condition, count(*) AS n, count(DISTINCT p.rid) AS n_respondents FROM p JOIN ok ON ok.rid = p.rid GROUP BY p.condition")
def _(spark, d):
    df = FX.predictions(spark, d)
    ok = df.where("parse_ok").groupBy("rid").agg(F.countDistinct("condition").alias("k"), F.count("*").alias("n")).where("k = 6 and n = 48").select("rid")
    return df.join(ok, "rid", "left_semi").groupBy("condition").agg(F.count("*").alias("n"), F.countDistinct("rid").alias("n_respondents"))


@query("jn_condition_semi", f"{P} SELECT condition, count(*) AS n, round(avg(err), 6) AS err FROM p WHERE rid IN (SELECT rid FROM p WHERE condition = 'Full' AND item = 'VIEWS' AND parse_ok) GROUP BY condition")
def _(spark, d):
    df = pred(spark, d)
    anchor = df.where("condition = 'Full' and item = 'VIEWS' and parse_ok").select("rid")
    return df.join(anchor, "rid", "left_semi").groupBy("condition").agg(F.count("*").alias("n"), T.r6(F.avg("err")).alias("err"))


# --- aggregations ------------------------------------------------------------------------------------------------------


@query("ag_summary_cells", f"{A} SELECT model, prompt, item, round(avg(CAST(abs_err AS DOUBLE)), 6) AS abs_err, count(*) AS n FROM p WHERE parse_ok GROUP BY model, prompt, item")
def _(spark, d):
    return panel(spark, d).where("parse_ok").groupBy("model", "prompt", "item").agg(T.r6(F.avg(F.col("abs_err").cast("double"))).alias("abs_err"), F.count("*").alias("n"))


@query("ag_respondent_condition", f"""{A}, k AS (SELECT *, CASE WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR coalesce(pred_code = 7, FALSE))) THEN 'c' ELSE 'l' END AS t FROM p),
 i AS (SELECT rid, model, prompt, condition, item, sum(CASE WHEN parse_ok AND t = 'l' THEN abs_err END) AS e, count(*) FILTER (parse_ok AND t = 'l') AS nl, count(*) FILTER (parse_ok AND t = 'l' AND abs_err <= 1) AS w, count(*) FILTER (parse_ok AND t = 'c') AS nc,
  count(*) FILTER (parse_ok AND t = 'c' AND abs_err = 0) AS m, count(*) FILTER (NOT parse_ok) AS f, count(*) AS n, max(CASE WHEN sample = 1 THEN pred_code END) AS s1, max(CASE WHEN sample = 2 THEN pred_code END) AS s2 FROM k GROUP BY rid, model, prompt, condition, item)
 SELECT rid, model, prompt, condition, round(CAST(sum(e) AS DOUBLE) / sum(nl), 3) AS likert_mae, round(100 * CAST(sum(w) AS DOUBLE) / nullif(sum(nl), 0), 1) AS within1, round(100 * CAST(sum(m) AS DOUBLE) / nullif(sum(nc), 0), 1) AS cat_match,
  round(100 * CAST(sum(f) AS DOUBLE) / sum(n), 1) AS parse_failure, round(100 * avg(CASE WHEN s1 = s2 THEN CAST(1 AS DOUBLE) WHEN s1 <> s2 THEN 0 END), 1) AS self_consistency FROM i GROUP BY rid, model, prompt, condition""")
def _(spark, d):
    return T.respondent_condition(panel(spark, d))


@query("ag_condition_three_ways", f"""{P}, i AS (SELECT condition, avg(m) AS item_macro FROM (SELECT condition, item, avg(err) AS m FROM p GROUP BY condition, item) q GROUP BY condition),
 r AS (SELECT condition, avg(m) AS respondent_macro, count(*) AS n FROM (SELECT condition, rid, avg(err) AS m FROM p GROUP BY condition, rid) q GROUP BY condition)
 SELECT i.condition, round(respondent_macro, 6) AS respondent_macro, n AS n_respondents, round(item_macro, 6) AS item_macro, round(pooled, 6) AS pooled FROM i JOIN r ON i.condition = r.condition JOIN (SELECT condition, avg(err) AS pooled FROM p GROUP BY condition) q ON q.condition = i.condition""")
def _(spark, d):
    return T.condition_three_ways(pred(spark, d))


@query("ag_t0_raw", f"{P} SELECT item, condition, coalesce(model, 'combined') AS model, round(avg(err), 6) AS err, count(*) AS n FROM p GROUP BY GROUPING SETS ((item, condition, model), (item, condition))")
def _(spark, d):
    return T.item_table(pred(spark, d), ["item", "condition", "model"])


@query("ag_t1_baseline", f"{P} SELECT item, coalesce(model, 'combined') AS model, round(avg(err), 6) AS err, count(*) AS n FROM p WHERE condition = 'Full' GROUP BY GROUPING SETS ((item, model), (item))")
def _(spark, d):
    return T.item_table(pred(spark, d).where("condition = 'Full'"), ["item", "model"])


@query("ag_t2_bin_delta", f"{_MEANS} SELECT condition, round(avg(delta), 6) AS delta, count(*) AS n FROM pairs WHERE condition LIKE 'drop_%' GROUP BY condition")
def _(spark, d):
    return T.bin_delta(pred(spark, d))


@query("ag_t3_battery_delta", f"{_ABL} SELECT battery, bin, round(avg(other - base), 6) AS delta, count(*) AS n_pairs, count(DISTINCT rid) AS n_respondents, count(DISTINCT item) AS n_items FROM ab JOIN batteries USING (battery_no) GROUP BY battery, bin")
def _(spark, d):
    return T.battery_delta(pred(spark, d), FX.batteries(spark))


@query("ag_missingness", f"{P} SELECT count(*) AS pairs, count(*) FILTER (a.parse_ok AND b.parse_ok) AS both_parsed, count(*) FILTER (NOT a.parse_ok AND b.parse_ok) AS base_failed, count(*) FILTER (a.parse_ok AND NOT b.parse_ok) AS ablated_failed FROM p a JOIN p b ON a.rid = b.rid AND a.item = b.item AND a.condition = 'Full' AND b.condition = 'random_battery_drop'")
def _(spark, d):
    return T.missing_pairs(pred(spark, d))


@query("ag_t5_parse_fail", f"{P} SELECT item, model, round(1 - avg(CASE WHEN parse_ok THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS parse_fail, count(*) AS n FROM p GROUP BY item, model")
def _(spark, d):
    return T.parse_failures(pred(spark, d))


@query("ag_cell_parse_rate", f"{A} SELECT model, prompt, round(1 - avg(CASE WHEN parse_ok THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS parse_fail, count(*) AS n FROM p GROUP BY model, prompt")
def _(spark, d):
    return panel(spark, d).groupBy("model", "prompt").agg(T.r6(1 - F.avg(F.col("parse_ok").cast("double"))).alias("parse_fail"), F.count("*").alias("n"))


_VAR = f"{A}, cv AS (SELECT model, prompt, item, round(var_pop(m), 6) AS variance, count(*) AS n FROM (SELECT model, prompt, item, rid, avg(CAST(pred_code AS DOUBLE)) AS m FROM p WHERE parse_ok GROUP BY model, prompt, item, rid) q GROUP BY model, prompt, item), hv AS (SELECT item, count(*) AS n, round(var_pop(CAST(true_code AS DOUBLE)), 6) AS human_variance, round(var_pop(CAST(true_code AS DOUBLE)) * 0.3, 6) AS threshold FROM truth GROUP BY item)"


@query("ag_cell_variance", f"{_VAR} SELECT * FROM cv")
def _(spark, d):
    return T.cell_variance(panel(spark, d))


@query("ag_human_variance", f"{_VAR} SELECT * FROM hv")
def _(spark, d):
    return T.human_variance(FX.truth(spark, d))


_GATE = f"{_VAR}, gate AS (SELECT model, prompt, count(*) AS n_items, count(*) FILTER (variance / human_variance < 0.30) AS n_low, round(avg(CASE WHEN variance / human_variance < 0.30 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS share_low, avg(CASE WHEN variance / human_variance < 0.30 THEN CAST(1 AS DOUBLE) ELSE 0 END) <= 0.30 AS passes FROM cv JOIN hv USING (item) WHERE human_variance > 0 GROUP BY model, prompt)"


@query("ag_dq3", f"{_GATE} SELECT * FROM gate")
def _(spark, d):
    return T.variance_gate(T.cell_variance(panel(spark, d)), T.human_variance(FX.truth(spark, d)))


_CELL = "macro AS (SELECT model, prompt, round(avg(m), 6) AS macro, count(*) AS n FROM (SELECT model, prompt, rid, avg(err) AS m FROM p GROUP BY model, prompt, rid) q GROUP BY model, prompt)"


_MODE = f"{TR}, k AS (SELECT item, true_code, count(*) AS n FROM truth GROUP BY item, true_code), md AS (SELECT item, min(true_code) FILTER (n = m) AS mode, max(n) AS n_mode, CAST(sum(n) AS BIGINT) AS n, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS share FROM (SELECT *, max(n) OVER (PARTITION BY item) AS m FROM k) q GROUP BY item), mb AS (SELECT t.rid, t.item, CASE WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR mode = 7)) THEN CAST(mode <> true_code AS BIGINT) ELSE abs(mode - true_code) END / CAST(hi - lo AS DOUBLE) AS err FROM truth t JOIN md ON md.item = t.item)"


@query("ag_majority_em", f"{_MODE} SELECT * FROM md")
def _(spark, d):
    return T.majority(FX.truth(spark, d))


@query("ag_majority_baseline", f"{_MODE} SELECT round(a.m, 6) AS respondent_macro, a.n, round(b.m, 6) AS item_macro FROM (SELECT avg(m) AS m, count(*) AS n FROM (SELECT rid, avg(err) AS m FROM mb GROUP BY rid) q) a, (SELECT avg(m) AS m FROM (SELECT item, avg(err) AS m FROM mb GROUP BY item) q) b")
def _(spark, d):
    return T.majority_baseline(FX.truth(spark, d))


_PROFILE = """SELECT {0}, item, CAST(sum(n) AS BIGINT) AS n_total, CAST(sum(ok) AS BIGINT) AS n_ok, CAST(sum(n) - sum(ok) AS BIGINT) AS n_pf, CAST(sum(hit) AS BIGINT) AS n_exact, round(sum(hit) / sum(ok), 6) AS em, round(CAST(sum(ok) AS DOUBLE) / sum(n), 6) AS parse_rate, round(sum(err) / sum(n), 6) AS err,
 count(*) FILTER (ok > 0) AS distinct_codes, round(CAST(max(ok) AS DOUBLE) / sum(ok), 6) AS top1_share FROM (SELECT {0}, item, pred_code, count(*) AS n, count(*) FILTER (parse_ok) AS ok, sum(exact0) AS hit, sum(err) AS err FROM p GROUP BY {0}, item, pred_code) h GROUP BY {0}, item"""


@query("ag_collapse", f"{A}, pr AS ({_PROFILE.format('model')}) SELECT model, pr.item, distinct_codes, top1_share, CASE WHEN hi - lo + 1 >= 3 THEN top1_share > 0.95 ELSE distinct_codes = 1 END AS collapsed FROM pr JOIN items ON items.item = pr.item")
def _(spark, d):
    return T.collapse(panel(spark, d))


@query("ag_binary_em", f"{A} SELECT model, round(sum(exact0) / count(*), 6) AS em, count(*) AS n FROM p WHERE fmt = 'binary' GROUP BY model")
def _(spark, d):
    return panel(spark, d).where("fmt = 'binary'").groupBy("model").agg(T.r6(F.sum("exact0") / F.count("*")).alias("em"), F.count("*").alias("n"))


@query("ag_weighted_item", f"{A} SELECT item, round(sum(em * n_ok) / sum(n_ok), 6) AS em_weighted, round(avg(em), 6) AS em_macro, CAST(sum(n_ok) AS BIGINT) AS n FROM ({_PROFILE.format('model, prompt')}) q GROUP BY item")
def _(spark, d):
    prof = T.item_profile(panel(spark, d), ["model", "prompt"])
    return prof.groupBy("item").agg(T.r6(F.sum(F.col("em") * F.col("n_ok")) / F.sum("n_ok")).alias("em_weighted"), T.r6(F.avg("em")).alias("em_macro"), F.sum("n_ok").alias("n"))


@query("ag_no_profile", f"""{P}, t AS (SELECT item, true_code AS code, count(*) AS t FROM p WHERE condition = 'Full' GROUP BY item, true_code), q AS (SELECT item, pred_code AS code, count(*) AS q FROM p WHERE condition = 'Full' AND pred_code IS NOT NULL GROUP BY item, pred_code),
 h AS (SELECT coalesce(t.item, q.item) AS item, coalesce(t.code, q.code) AS code, coalesce(t, 0) AS t, coalesce(q, 0) AS q FROM t FULL JOIN q ON t.item = q.item AND t.code = q.code), s AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY q DESC, code) AS rk FROM h),
 g AS (SELECT item, CAST(max(t) AS DOUBLE) / sum(t) AS base, CAST(sum(t * q) AS DOUBLE) / (sum(t) * sum(q)) AS ex, CAST(max(CASE WHEN rk = 1 THEN t END) AS DOUBLE) / sum(t) AS hit FROM s GROUP BY item)
 SELECT item, round(base, 6) AS base_rate, round(hit, 6) AS mode_match, round(ex, 6) AS expected_match, round((ex - base) / (1 - base), 6) AS lift FROM g""")
def _(spark, d):
    return T.no_profile(pred(spark, d).where("condition = 'Full'"))


@query("ag_agreement", f"""{A}, q AS (SELECT rid, prompt, condition, item, sample, count(DISTINCT model) AS k, bool_and(parse_ok) AS ok, min(pred_code) AS a, max(pred_code) AS b FROM p GROUP BY rid, prompt, condition, item, sample)
 SELECT prompt, condition, count(*) AS n, count(*) FILTER (ok AND a = b) AS agree, round(100 * avg(CASE WHEN ok AND a = b THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS agreement FROM q WHERE k = 4 GROUP BY prompt, condition""")
def _(spark, d):
    return T.agreement(panel(spark, d), FX.MODELS)


@query("ag_panel_code", f"""{A}, q AS (SELECT rid, prompt, condition, item, sample, lo, hi, fmt, bool_and(parse_ok) AS ok, list_sort(list(pred_code)) AS codes, sum(CASE WHEN pred_code = 7 THEN 1 ELSE 0 END) AS seven FROM p GROUP BY rid, prompt, condition, item, sample, lo, hi, fmt HAVING count(DISTINCT model) = 4),
 o AS (SELECT *, CASE WHEN fmt IN ('binary', 'categorical') OR (fmt = 'contingent' AND seven > 0) THEN list_sort(list_filter(list_distinct(codes), lambda c: len(list_filter(codes, lambda x: x = c)) = list_max(list_transform(list_distinct(codes), lambda e: len(list_filter(codes, lambda x: x = e))))))
  ELSE list_filter(range(lo, hi + 1), lambda c: abs(2 * c - codes[2] - codes[3]) = list_min(list_transform(range(lo, hi + 1), lambda e: abs(2 * e - codes[2] - codes[3])))) END AS options FROM q)
 SELECT rid, prompt, condition, item, CAST(sample AS BIGINT) AS sample, ok, CASE WHEN ok THEN CASE WHEN len(options) = 1 THEN options[1] ELSE options[CAST(CAST('0x' || substr(sha256(item || '|' || CAST(rid AS VARCHAR) || '|' || array_to_string(codes, ',') || '|' || array_to_string(options, ',')), 1, 8) AS UBIGINT) % CAST(len(options) AS UBIGINT) AS BIGINT) + 1] END END AS panel_code FROM o""")
def _(spark, d):
    return T.panel_code(panel(spark, d), FX.MODELS)


@query("ag_run_health", "SELECT event_id % 4 AS model_no, count(*) AS n, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS ok, count(*) FILTER (event_type = 'signup') AS parse_fail, count(*) FILTER (event_type = 'error') AS provider_error, round(100 * CAST(count(*) FILTER (event_type IN ('error', 'signup')) AS DOUBLE) / count(*), 6) AS bad_percent FROM events GROUP BY 1")
def _(spark, d):
    return T.run_health(spark.read.parquet(f"{d}/events.parquet"))


@query("ag_self_error", f"{A} SELECT model, prompt, count(*) AS n, round(avg(CAST(abs(a - b) AS DOUBLE)), 6) AS self_error, round(avg(CASE WHEN a = b THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS self_match FROM (SELECT model, prompt, rid, item, max(CASE WHEN sample = 1 THEN pred_code END) AS a, max(CASE WHEN sample = 2 THEN pred_code END) AS b FROM p GROUP BY model, prompt, rid, item) q WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY model, prompt")
def _(spark, d):
    two = panel(spark, d).groupBy("model", "prompt", "rid", "item").agg(F.max(F.when(F.col("sample") == 1, F.col("pred_code"))).alias("a"), F.max(F.when(F.col("sample") == 2, F.col("pred_code"))).alias("b")).where("a is not null and b is not null")
    return two.groupBy("model", "prompt").agg(F.count("*").alias("n"), T.r6(F.avg(F.abs(F.col("a") - F.col("b")).cast("double"))).alias("self_error"), T.r6(F.avg((F.col("a") == F.col("b")).cast("double"))).alias("self_match"))


@query("ag_arm_summary", f"{P} SELECT condition, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS sd, count(*) AS n FROM (SELECT condition, rid, avg(err) AS m FROM p GROUP BY condition, rid) q GROUP BY condition")
def _(spark, d):
    m = pred(spark, d).groupBy("condition", "rid").agg(F.avg("err").alias("m"))
    return m.groupBy("condition").agg(T.r6(F.avg("m")).alias("mean"), T.r6(F.stddev_samp("m")).alias("sd"), F.count("*").alias("n"))


@query("ag_label_baseline", "SELECT count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS quality, round(avg(CAST(toxic AS DOUBLE)), 6) AS toxic, round(greatest(avg(CAST(quality AS DOUBLE)), 1 - avg(CAST(quality AS DOUBLE))), 6) AS majority FROM labels JOIN documents USING (doc_id)")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), "doc_id")
    q = F.avg(F.col("quality").cast("double"))
    return rows.agg(F.count("*").alias("n"), T.r6(q).alias("quality"), T.r6(F.avg(F.col("toxic").cast("double"))).alias("toxic"), T.r6(F.greatest(q, 1 - q)).alias("majority"))


# --- windows, decompositions, decisions --------------------------------------------------------------------------------


@query("st_holm", f"""{_ABL}, f AS (SELECT bin, battery AS key, count(*) AS n, round(CAST(count(*) FILTER (other <= base) AS DOUBLE) / count(*), 6) / 20 AS p FROM ab JOIN batteries USING (battery_no) GROUP BY bin, battery),
 g AS (SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY bin) - row_number() OVER (PARTITION BY bin ORDER BY p, key) + 1)) AS raw, row_number() OVER (PARTITION BY bin ORDER BY p, key) AS rk FROM f)
 SELECT bin, key, n, round(p, 6) AS p, round(max(raw) OVER (PARTITION BY bin ORDER BY rk), 6) AS p_adj, max(raw) OVER (PARTITION BY bin ORDER BY rk) <= 0.05 AS significant FROM g""")
def _(spark, d):
    pairs = T.pair_ablation(pred(spark, d)).join(F.broadcast(FX.batteries(spark)), "battery_no")
    f = pairs.groupBy("bin", F.col("battery").alias("key")).agg(F.count("*").alias("n"), (T.r6(F.count_if(F.col("other") <= F.col("base")) / F.count("*")) / 20).alias("p"))
    return T.holm(f, ["bin"]).select("bin", "key", "n", T.r6("p").alias("p"), T.r6("p_adj").alias("p_adj"), "significant")


_SUB = f"{P}, sub AS (SELECT CAST(mask AS BIGINT) AS mask, avg(err) AS value FROM (SELECT err, (rid * 7 + item_no * 3 + cond_no) % 16 AS mask FROM p) q GROUP BY mask)"
_W = "CASE bit_count(CAST(a.mask AS INTEGER)) WHEN 0 THEN 0.25 WHEN 1 THEN CAST(1 AS DOUBLE) / 12 WHEN 2 THEN CAST(1 AS DOUBLE) / 12 ELSE 0.25 END"


def _subsets(spark, d):
    return pred(spark, d).groupBy(((F.col("rid") * 7 + F.col("item_no") * 3 + F.col("cond_no")) % 16).alias("mask")).agg(F.avg("err").alias("value"))


@query("st_shapley", f"{_SUB} SELECT CAST(b.player AS INTEGER) AS player, round(sum({_W} * (a.value - c.value)), 6) AS shapley FROM sub a, (SELECT unnest([0, 1, 2, 3]) AS player) b, sub c WHERE (a.mask >> b.player) % 2 = 0 AND c.mask = a.mask + (1 << b.player) GROUP BY b.player")
def _(spark, d):
    return ST.shapley(_subsets(spark, d))


_ALPHA = f"{_SUB}, alpha AS (SELECT CAST(t.mask AS INTEGER) AS term, round(sum(CASE WHEN bit_count(CAST(t.mask & s.mask AS INTEGER)) % 2 = 0 THEN s.value ELSE -s.value END) / 16, 6) AS alpha FROM sub t, sub s GROUP BY t.mask)"


@query("st_anova_contrasts", f"{_ALPHA} SELECT * FROM alpha")
def _(spark, d):
    return ST.contrasts(_subsets(spark, d))


@query("st_interaction_share", f"{_ALPHA} SELECT round(sum(alpha * alpha) FILTER (bit_count(term) >= 2) / sum(alpha * alpha) FILTER (bit_count(term) >= 1), 6) AS share FROM alpha")
def _(spark, d):
    return ST.interaction_share(ST.contrasts(_subsets(spark, d)))


@query("st_wilcoxon", f"""{_MEANS}, dd AS (SELECT round(delta, 6) AS delta FROM pairs WHERE condition = 'drop_attitudinal' AND round(delta, 6) <> 0), r AS (SELECT delta, rank() OVER (ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY abs(delta)) - 1) / CAST(2 AS DOUBLE) AS r FROM dd),
 t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM dd GROUP BY abs(delta)) q), s AS (SELECT count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS w FROM r)
 SELECT n, round(w, 1) AS w_plus, round((w - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s, t""")
def _(spark, d):
    pairs = T.pair_conditions(pred(spark, d)).where("condition = 'drop_attitudinal'")
    return ST.wilcoxon(pairs.select(T.r6("delta").alias("delta")))


@query("st_router", f"""{A}, parts AS (SELECT c_custkey AS rid, CASE WHEN {_UNIT.format('c_custkey')} < {2**31} THEN 'train' ELSE 'test' END AS part FROM customer),
 r AS (SELECT item, model, sum(CASE WHEN part = 'train' THEN err END) AS a, count(*) FILTER (part = 'train') AS na, sum(CASE WHEN part = 'test' THEN err END) AS b, count(*) FILTER (part = 'test') AS nb FROM p JOIN parts USING (rid) GROUP BY item, model),
 s AS (SELECT model, sum(b) / sum(nb) AS single, row_number() OVER (ORDER BY sum(a) / sum(na), model) AS rk FROM r GROUP BY model),
 i AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY a / na, model) AS r1, row_number() OVER (PARTITION BY item ORDER BY b / nb, model) AS r2 FROM r),
 g AS (SELECT sum(b) FILTER (r1 = 1) / sum(nb) FILTER (r1 = 1) AS routed, sum(b) FILTER (r2 = 1) / sum(nb) FILTER (r2 = 1) AS oracle FROM i)
 SELECT model AS best_single, round(routed, 6) AS routed, round(single, 6) AS single, round(oracle, 6) AS oracle, round(single - routed, 6) AS gain FROM g, s WHERE rk = 1""")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"))
    return T.router(panel(spark, d), C.split(ids, 0.5))


@query("sel_joint_cell", f"""{_GATE}, {_CELL}, pf AS (SELECT model, prompt, round(1 - avg(CASE WHEN parse_ok THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS parse_fail FROM p GROUP BY model, prompt),
 j AS (SELECT model, prompt, parse_fail, share_low, macro, parse_fail <= 0.10 AND coalesce(passes, TRUE) AS survives FROM pf JOIN macro USING (model, prompt) LEFT JOIN gate USING (model, prompt)),
 k AS (SELECT *, CASE WHEN survives THEN row_number() OVER (PARTITION BY survives ORDER BY macro, model, prompt) END AS rank FROM j) SELECT *, coalesce(rank, 0) = 1 AS chosen FROM k""")
def _(spark, d):
    return D.cells(panel(spark, d), T.human_variance(FX.truth(spark, d)))


@query("sel_gap_warning", f"""{A}, {_CELL}, k AS (SELECT item, true_code, count(*) AS n FROM truth GROUP BY item, true_code), md AS (SELECT item, min(true_code) FILTER (n = m) AS mode FROM (SELECT *, max(n) OVER (PARTITION BY item) AS m FROM k) q GROUP BY item),
 b AS (SELECT round(avg(m), 6) AS baseline FROM (SELECT rid, avg(CASE WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR mode = 7)) THEN CAST(mode <> true_code AS BIGINT) ELSE abs(mode - true_code) END / CAST(hi - lo AS DOUBLE)) AS m FROM truth t JOIN md ON md.item = t.item GROUP BY rid) q)
 SELECT best, baseline, round(baseline - best, 6) AS gap, CASE WHEN round(baseline - best, 6) < 0 THEN 'warn' WHEN round(baseline - best, 6) < 0.02 THEN 'note' ELSE 'ok' END AS flag FROM (SELECT min(macro) AS best FROM macro) a, b""")
def _(spark, d):
    best = T.respondent_macro(panel(spark, d), ["model", "prompt"]).agg(F.min("macro").alias("best"))
    return D.gap_warning(best, T.majority_baseline(FX.truth(spark, d)).select(F.col("respondent_macro").alias("baseline")))


# --- sets, text --------------------------------------------------------------------------------------------------------


@query("set_membership_checks", "SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (b AND NOT a) AS only_b FROM (SELECT k, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT c_custkey AS k, 1 AS s FROM customer UNION ALL SELECT o_custkey, 2 FROM orders) q GROUP BY k) r")
def _(spark, d):
    return X.membership(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k")), spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k")))


@query("set_record_equality", "SELECT (SELECT count(*) FROM (SELECT event_id FROM events WHERE event_id % 3 <> 0 EXCEPT ALL SELECT event_id FROM events WHERE event_id % 5 <> 0) q) AS missing, (SELECT count(*) FROM (SELECT event_id FROM events WHERE event_id % 5 <> 0 EXCEPT ALL SELECT event_id FROM events WHERE event_id % 3 <> 0) q) AS extra, (SELECT count(*) FROM (SELECT event_id FROM events WHERE event_id % 3 <> 0 GROUP BY event_id HAVING count(*) > 1) q) AS duplicate_keys")
def _(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id")
    return X.record_equality(e.where("event_id % 3 <> 0"), e.where("event_id % 5 <> 0"), ["event_id"])


@query("set_union_prompts", f"{A} SELECT prompt, count(*) AS n, count(DISTINCT rid) AS n_respondents FROM p GROUP BY prompt")
def _(spark, d):
    df = FX.panel(spark, d)
    return X.union_prompts([df.where(F.col("prompt") == x) for x in FX.PROMPTS]).groupBy("prompt").agg(F.count("*").alias("n"), F.countDistinct("rid").alias("n_respondents"))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_LABELS = [("SEGMENT", i + 1, s.title()) for i, s in enumerate(SEGMENTS)] + [("SEGMENT", 8, "No answer")]
_BINS = [("SEGMENT", "behavioral"), ("NATION", "demographic"), ("BALANCE", "psychological")]
_ANSWERS = f"answers AS (SELECT c_custkey AS rid, CASE WHEN c_custkey % 37 = 0 THEN 8 ELSE coalesce(list_position([{', '.join(repr(s) for s in SEGMENTS)}], c_mktsegment), -97) END AS SEGMENT, CASE WHEN c_custkey % 50 = 0 THEN -99 ELSE c_nationkey + 1 END AS NATION, CASE WHEN c_acctbal < 0 THEN 1 ELSE 2 END AS BALANCE FROM customer)"
_FEATURES = f"""WITH {_ANSWERS}, feats AS (SELECT rid, var, bin, label FROM (
 SELECT rid, 'SEGMENT' AS var, 'behavioral' AS bin, 2 AS o, CASE WHEN SEGMENT = 8 OR SEGMENT < 0 THEN NULL ELSE upper(substr(l, 1, 1)) || lower(substr(l, 2)) END AS label FROM (SELECT *, [{', '.join(repr(s) for s in SEGMENTS)}][SEGMENT] AS l FROM answers) q
 UNION ALL SELECT rid, 'NATION', 'demographic', 1, CASE WHEN NATION > 0 THEN CAST(NATION AS VARCHAR) END FROM answers
 UNION ALL SELECT rid, 'BALANCE', 'psychological', 3, CAST(BALANCE AS VARCHAR) FROM answers) q WHERE label IS NOT NULL)"""


def _features(spark, d):
    seg = F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment"))
    rid = F.col("c_custkey")
    a = spark.read.parquet(f"{d}/customer.parquet").select(
        rid.alias("rid"), F.when(rid % 37 == 0, 8).when(seg > 0, seg).otherwise(-97).cast("long").alias("SEGMENT"), F.when(rid % 50 == 0, -99).otherwise(F.col("c_nationkey") + 1).cast("long").alias("NATION"), F.when(F.col("c_acctbal") < 0, 1).otherwise(2).cast("long").alias("BALANCE")
    )
    labels = spark.createDataFrame(_LABELS, "var string, code long, label string")
    return a, TX.features_long(a, ["SEGMENT", "NATION", "BALANCE"], labels, spark.createDataFrame(_BINS, "var string, bin string"))


@query("txt_features_long", f"{_FEATURES} SELECT * FROM feats")
def _(spark, d):
    return _features(spark, d)[1]


_LINE = "CASE bin WHEN 'demographic' THEN 1 WHEN 'behavioral' THEN 2 ELSE 3 END"


@query("txt_render_kv", f"{_FEATURES} SELECT a.rid, coalesce(string_agg('## ' || bin || chr(10) || '- ' || var || ': ' || label, chr(10) ORDER BY {_LINE}), '') AS profile, count(var) AS feature_count FROM answers a LEFT JOIN feats ON feats.rid = a.rid GROUP BY a.rid")
def _(spark, d):
    a, f = _features(spark, d)
    return TX.render_profile(f, a)


@query("txt_render_prose", f"{_FEATURES} SELECT a.rid, coalesce(string_agg('My ' || lower(var) || ' is ' || lower(label) || '.', chr(10) ORDER BY {_LINE}), '') AS profile, count(var) AS feature_count FROM answers a LEFT JOIN feats ON feats.rid = a.rid GROUP BY a.rid")
def _(spark, d):
    a, f = _features(spark, d)
    return TX.render_profile(f, a, "prose")


@query("txt_profile_stats", f"{_FEATURES} SELECT a.rid, count(var) AS feature_count, CAST(length(coalesce(string_agg('Q: ' || var || '?' || chr(10) || 'A: ' || label, chr(10)), '')) AS BIGINT) AS char_count, CAST(length(coalesce(string_agg('Q: ' || var || '?' || chr(10) || 'A: ' || label, chr(10)), '')) // 4 AS BIGINT) AS approx_tokens FROM answers a LEFT JOIN feats ON feats.rid = a.rid GROUP BY a.rid")
def _(spark, d):
    a, f = _features(spark, d)
    return TX.profile_stats(TX.render_profile(f, a, "qa"))


_RULES = [("licence", "licen[cs]e"), ("shout", "!!"), ("list", r" \| ")]


@query("txt_phrase_scan", f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents WHERE source NOT IN ('src3')),
 k AS (SELECT *, lower(line) AS low FROM l) SELECT doc_id, line_no, rule FROM (SELECT doc_id, line_no, low, unnest(['licence', 'shout', 'list']) AS rule FROM k) q
 WHERE NOT regexp_matches(low, '\\b(not|no|never)\\b') AND CASE rule WHEN 'licence' THEN regexp_matches(low, 'licen[cs]e') WHEN 'shout' THEN regexp_matches(low, '!!') ELSE regexp_matches(low, ' \\| ') END""")
def _(spark, d):
    return TX.phrase_scan(spark.read.parquet(f"{d}/documents.parquet"), _RULES, exempt=("src3",))


@query("txt_likert_extract", f"""{P} SELECT rid, item, condition, CASE WHEN rid % 3 = 0 THEN CASE WHEN pred_code <= 5 AND pred_code >= 1 THEN pred_code ELSE 2 END WHEN pred_code <= 5 AND pred_code >= 1 THEN pred_code END AS answer FROM p WHERE parse_ok""".replace("AS answer FROM p", "AS answer FROM p"))
def _(spark, d):
    text = F.concat(F.when(F.col("rid") % 3 == 0, "two, or rather ").otherwise("I say "), F.col("pred_code").cast("string"), F.lit("."))
    return FX.predictions(spark, d).where("parse_ok").select("rid", "item", "condition", TX.likert_answer(text, 5).cast("long").alias("answer"))


@query("wn_rank_in_bin", f"{_ABL}, z AS (SELECT battery, bin, round(avg(other - base), 6) AS delta FROM ab JOIN batteries USING (battery_no) GROUP BY battery, bin) SELECT *, row_number() OVER (PARTITION BY bin ORDER BY delta DESC, battery) AS rank FROM z")
def _(spark, d):
    from pyspark.sql import Window

    rows = T.battery_delta(pred(spark, d), FX.batteries(spark)).select("battery", "bin", "delta")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("delta"), "battery")).cast("long"))


@query("wn_top1", f"{P} SELECT model, item, min(pred_code) FILTER (n = m) AS code, max(n) AS n, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS share FROM (SELECT *, max(n) OVER (PARTITION BY model, item) AS m FROM (SELECT model, item, pred_code, count(*) AS n FROM p WHERE parse_ok GROUP BY model, item, pred_code) q) r GROUP BY model, item")
def _(spark, d):
    h = pred(spark, d).where("parse_ok").groupBy("model", "item", "pred_code").agg(F.count("*").alias("n"))
    return h.groupBy("model", "item").agg(F.min_by("pred_code", F.struct(-F.col("n"), F.col("pred_code"))).alias("code"), F.max("n").alias("k"), F.sum("n").alias("s")).select("model", "item", "code", F.col("k").alias("n"), T.r6(F.col("k") / F.col("s")).alias("share"))


@query("wn_drop_ranking", f"{P}, z AS (SELECT condition, avg(err) AS e FROM p GROUP BY condition) SELECT a.condition, round(a.e - b.e, 6) AS delta, row_number() OVER (ORDER BY round(a.e - b.e, 6) DESC, a.condition) AS rank FROM z a JOIN z b ON b.condition = 'Full' AND a.condition <> 'Full'")
def _(spark, d):
    from pyspark.sql import Window

    e = pred(spark, d).groupBy("condition").agg(F.avg("err").alias("e"))
    base = e.where("condition = 'Full'").select(F.col("e").alias("b"))
    rows = e.where("condition <> 'Full'").join(F.broadcast(base)).select("condition", T.r6(F.col("e") - F.col("b")).alias("delta"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("delta"), "condition")).cast("long"))


# --- statistics with resampling: rows only, closed forms are checked by tests ------------------------------------------


@query("st_paired_delta")
def _(spark, d):
    pairs = T.pair_conditions(pred(spark, d)).where(F.col("condition").startswith("drop_")).withColumn("one", F.lit(1.0))
    return ST.ratio_intervals(pairs, ["condition"], "delta", "one")


@query("st_cluster_ratio")
def _(spark, d):
    pairs = T.pair_ablation(pred(spark, d)).groupBy("rid").agg(F.sum(F.col("other") - F.col("base")).alias("s"), F.count("*").cast("double").alias("c"))
    return ST.ratio_intervals(pairs.withColumn("g", F.lit(0)), ["g"], "s", "c").drop("g")


@query("st_clustered_ols")
def _(spark, d):
    df = panel(spark, d).select("rid", "err", *[(F.col("model") == m).cast("double").alias(m) for m in FX.MODELS[1:]], *[(F.col("prompt") == p).cast("double").alias(p) for p in FX.PROMPTS[1:]])
    return spark.createDataFrame(ST.clustered_ols(df, [*FX.MODELS[1:], *FX.PROMPTS[1:]], "err"), "term string, coef double, se double, lo double, hi double, p double, n long")
