"""Registered queries of grids, profile checks, cell tables, re-scoring, resampling and regressions; SQL where it can give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as C
from ..operators import encode as E
from ..operators import grid as G
from ..operators import report as R
from ..operators import resample as RS
from ..operators import rescore as RC
from ..operators import tables as T
from ..operators import text as TX
from . import fixtures as FX
from .queries import _FEATURES, _HEX, _SUB, _W, ORACLE_SQL, A, P, _features, _subsets, panel, pred, query

#: Features of the battery that an item belongs to, hidden when that item is asked.
MEMBERS = {"PARTY": ("NATION",), "VIEWS": ("BALANCE", "SEGMENT"), "TRUST": ("SEGMENT",), "HELP": ("BALANCE",)}
_HIDDEN = " OR ".join(f"(item = '{i}' AND var IN ({', '.join(repr(v) for v in vs)}))" for i, vs in MEMBERS.items())
_FEATS_TRUTH = _FEATURES.replace("WITH ", f"WITH {FX.TRUTH_SQL}, ", 1)
_FEATS_PRED = _FEATURES.replace("WITH ", f"WITH {FX.PRED_SQL}, ", 1)

# --- grids and profiles ------------------------------------------------------------------------------------------------


@query("txt_task_grid", f"WITH {FX.TRUTH_SQL} SELECT rid, item, c.condition, 'P1' AS prompt, s.sample, [{', '.join(repr(m) for m in FX.MODELS)}][{_HEX(chr(39) + '42|' + chr(39) + ' || CAST(rid AS VARCHAR) || ' + chr(39) + '|P1' + chr(39), 4)} + 1] AS model FROM truth, (VALUES {', '.join(f'({c!r})' for _, c, _ in FX.CONDITIONS)}) c(condition), (VALUES (1), (2)) s(sample)")
def _(spark, d):
    return G.task_grid(FX.truth(spark, d), [c for _, c, _ in FX.CONDITIONS], FX.MODELS, "P1", samples=2)


@query("txt_r1_exclusion", f"{_FEATS_TRUTH} SELECT t.rid, t.item, var, bin, label FROM truth t JOIN feats ON feats.rid = t.rid WHERE NOT ({_HIDDEN})")
def _(spark, d):
    return G.exclude_batteries(_features(spark, d)[1], FX.truth(spark, d), MEMBERS)


@query("txt_leak_check", f"{_FEATS_TRUTH} SELECT t.rid, t.item, var, 'off' AS rule FROM truth t JOIN feats ON feats.rid = t.rid WHERE {_HIDDEN}")
def _(spark, d):
    f, t = _features(spark, d)[1], FX.truth(spark, d)
    arms = [G.leaks(G.exclude_batteries(f, t, MEMBERS, on), MEMBERS).withColumn("rule", F.lit("on" if on else "off")) for on in (True, False)]
    return arms[0].unionByName(arms[1])


@query("txt_no_profile", "SELECT c_custkey AS rid, '' AS profile, CAST(0 AS BIGINT) AS feature_count FROM customer")
def _(spark, d):
    a, f = _features(spark, d)
    return TX.render_profile(f.where(~F.col("var").isin("SEGMENT", "NATION", "BALANCE")), a)


_PRE, _POST = "These are the answers of one respondent.", "Answer as this respondent would."
_BLOCK = "CASE WHEN count(*) FILTER (bin = '{0}') > 0 THEN '{1}' || chr(10) || string_agg('- ' || var || ': ' || label, chr(10) ORDER BY var) FILTER (bin = '{0}') || chr(10) || chr(10) ELSE '' END"


@query("txt_render_legacy", f"{_FEATURES} SELECT a.rid, '{_PRE}' || chr(10) || chr(10) || {' || '.join(_BLOCK.format(b, b.upper()) for b in TX.BINS)} || '{_POST}' AS profile, count(var) AS feature_count, {', '.join(f'count(*) FILTER (bin = {b!r}) AS n_{b}' for b in TX.BINS)} FROM answers a LEFT JOIN feats ON feats.rid = a.rid GROUP BY a.rid")
def _(spark, d):
    a, f = _features(spark, d)
    return G.legacy_profile(f, a, _PRE, _POST)


@query("txt_equivalence_check", f"{_FEATURES} SELECT a.rid, CAST(3 AS BIGINT) AS n_formats, count(var) AS n_features, TRUE AS agree FROM answers a LEFT JOIN feats ON feats.rid = a.rid GROUP BY a.rid")
def _(spark, d):
    a, f = _features(spark, d)
    return G.format_counts({style: TX.render_profile(f, a, style) for style in ("kv", "prose", "qa")})


@query("txt_format_check", f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') AS words FROM documents)
 SELECT doc_id, CAST(len(list_distinct(list_filter(words, lambda x: regexp_full_match(x, '[A-Z]{{3,}}') AND NOT list_contains([{', '.join(repr(c) for c in G.CAPITALS)}], x)))) AS BIGINT) AS n_capitals, regexp_matches(t, '\\{{[a-z_]+\\}}') AS placeholder, contains(lower(t), '(specify)') AS specify,
 len(list_filter(words, lambda x: regexp_full_match(x, '[0-9]+\\.0'))) > 0 AS bare_code FROM w""")
def _(spark, d):
    return G.format_flags(spark.read.parquet(f"{d}/documents.parquet"))


@query("txt_metadata_check", f"""{P}, m AS (SELECT rid, item, condition, CASE WHEN u % 500 = 0 THEN 'v0' ELSE 'v1' END AS prompt_version, CASE WHEN condition LIKE 'drop_%' THEN substr(condition, 6) END AS drop_bin, CASE WHEN u % 700 = 1 THEN 'attitudinal' WHEN condition LIKE 'drop_%' THEN substr(condition, 6) END AS stored_bin FROM p)
 SELECT rid, item, condition, 'prompt_version' AS field, prompt_version AS stored, 'v1' AS expected FROM m WHERE prompt_version <> 'v1' UNION ALL SELECT rid, item, condition, 'drop_bin', stored_bin, drop_bin FROM m WHERE stored_bin IS DISTINCT FROM drop_bin""")
def _(spark, d):
    dropped = F.when(F.col("condition").startswith("drop_"), F.substring("condition", 6, 99))
    rows = pred(spark, d).select("rid", "item", "condition", F.when(F.col("u") % 500 == 0, "v0").otherwise("v1").alias("prompt_version"), F.when(F.col("u") % 700 == 1, "attitudinal").otherwise(dropped).alias("drop_bin"))
    return G.metadata_mismatches(rows, {"prompt_version": F.lit("v1"), "drop_bin": dropped}, ["rid", "item", "condition"])


@query("txt_split_section", """WITH s AS (SELECT doc_id, coalesce(text, '') AS t, least(nullif(strpos(lower(coalesce(text, '')), 'license'), 0), nullif(strpos(lower(coalesce(text, '')), 'copyright'), 0)) AS s, nullif(strpos(lower(coalesce(text, '')), 'http'), 0) AS f FROM documents),
 h AS (SELECT *, substr(t, 1, coalesce(s, f) - 1) AS head FROM s), c AS (SELECT *, CAST(coalesce(length(head) - length(regexp_extract(head, '([^\\n]*)$', 1)), floor(length(t) * CAST(0.6 AS DOUBLE))) AS BIGINT) AS cut FROM h)
 SELECT doc_id, CASE WHEN s IS NOT NULL THEN 'stem' WHEN f IS NOT NULL THEN 'fallback' ELSE 'share' END AS how, substr(t, 1, cut) AS first, substr(t, cut + 1) AS second FROM c""")
def _(spark, d):
    return G.split_section(spark.read.parquet(f"{d}/documents.parquet"), ["license", "copyright"], "http", 0.6)


# --- tables ------------------------------------------------------------------------------------------------------------


@query("ag_marginal_means", " UNION ALL ".join(f"SELECT * FROM ({A} SELECT '{c}' AS factor, {c} AS level, round(avg(CASE WHEN parse_ok THEN exact0 END), 6) AS em_parsed, round(avg(exact0), 6) AS em_all, round(avg(CASE WHEN parse_ok THEN err END), 6) AS err_parsed, round(avg(err), 6) AS err_all FROM p GROUP BY {c}) q{i}" for i, c in enumerate(("model", "prompt"))))
def _(spark, d):
    return RC.marginal_means(panel(spark, d))


_RATES = {"cheap_a": 0.0001, "cheap_b": 0.0002, "cheap_c": 0.0004}
_RND = "CAST(1 AS DOUBLE) / (hi - lo + 1)"


@query("ag_databook", f"""{A}, k AS (SELECT item, true_code, count(*) AS n FROM truth GROUP BY item, true_code), md AS (SELECT item, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS maj_em FROM k GROUP BY item),
 h AS (SELECT model, prompt, item, pred_code, count(*) AS n FROM p WHERE parse_ok GROUP BY model, prompt, item, pred_code), dv AS (SELECT model, prompt, item, count(*) AS codes, CAST(max(n) AS DOUBLE) / sum(n) AS top1 FROM h GROUP BY model, prompt, item),
 c AS (SELECT model, prompt, item, lo, hi, avg(exact0) FILTER (parse_ok) AS em, avg(CAST(abs_err AS DOUBLE)) AS mae_raw, avg(err) AS mae_normalized, avg(CAST(abs_err <= 1 AS DOUBLE)) FILTER (parse_ok) AS w1, count(*) FILTER (parse_ok) AS n_eff, 1 - avg(CAST(parse_ok AS DOUBLE)) AS parse_fail_rate FROM p GROUP BY model, prompt, item, lo, hi),
 g AS (SELECT item, lo, hi, avg(CAST(list_sum(list_transform(range(lo, hi + 1), lambda x: abs(x - true_code))) AS DOUBLE)) AS total FROM truth GROUP BY item, lo, hi),
 j AS (SELECT c.*, codes, top1 FROM c JOIN dv USING (model, prompt, item) UNION ALL SELECT 'Uniform', '-', item, lo, hi, {_RND}, total / (hi - lo + 1), total / (hi - lo + 1) / (hi - lo), NULL, NULL, 0, hi - lo + 1, {_RND} FROM g)
 SELECT model, prompt, j.item, hi - lo + 1 AS k, round(em, 6) AS em, round(mae_raw, 6) AS mae_raw, round(mae_normalized, 6) AS mae_normalized, round(w1, 6) AS w1, n_eff, round(parse_fail_rate, 6) AS parse_fail_rate, maj_em, round({_RND}, 6) AS rnd_em,
 round((em - {_RND}) / (1 - {_RND}), 6) AS lift_rnd, round((em - maj_em) / (1 - maj_em), 6) AS lift_maj, codes AS pred_distinct_codes, round(top1, 6) AS pred_top1_share, CAST(CASE model WHEN 'cheap_a' THEN 0.0001 WHEN 'cheap_b' THEN 0.0002 WHEN 'cheap_c' THEN 0.0004 ELSE 0 END AS DOUBLE) AS cost_per_call FROM j JOIN md ON md.item = j.item""")
def _(spark, d):
    return RC.databook(panel(spark, d), FX.truth(spark, d), _RATES)


@query("ag_multimodel_headline", f"""{A}, pc AS (SELECT * FROM ({ORACLE_SQL['ag_panel_code']}) z), ag AS (SELECT * FROM ({ORACLE_SQL['ag_agreement']}) z), e AS (SELECT rid, prompt, item, model, err FROM p UNION ALL SELECT pc.rid, prompt, pc.item, 'panel',
 CASE WHEN ok THEN CASE WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR panel_code = 7)) THEN CAST(panel_code <> true_code AS BIGINT) ELSE abs(panel_code - true_code) END / CAST(hi - lo AS DOUBLE) ELSE 1.0 END FROM pc JOIN truth t ON t.rid = pc.rid AND t.item = pc.item),
 r AS (SELECT model, prompt, round(avg(m), 6) AS respondent_macro FROM (SELECT model, prompt, rid, avg(err) AS m FROM e GROUP BY model, prompt, rid) q GROUP BY model, prompt), i AS (SELECT model, prompt, round(avg(m), 6) AS item_macro FROM (SELECT model, prompt, item, avg(err) AS m FROM e GROUP BY model, prompt, item) q GROUP BY model, prompt)
 SELECT r.model, r.prompt, respondent_macro, item_macro, pooled, w.n, agreement FROM r JOIN i ON i.model = r.model AND i.prompt = r.prompt JOIN (SELECT model, prompt, round(avg(err), 6) AS pooled, count(*) AS n FROM e GROUP BY model, prompt) w ON w.model = r.model AND w.prompt = r.prompt LEFT JOIN ag ON ag.prompt = r.prompt""")
def _(spark, d):
    return RC.multimodel_headline(panel(spark, d), FX.MODELS)


@query("ag_unknown_codes", "SELECT * FROM (SELECT 'BALANCE' AS var, CAST(floor(c_acctbal) AS BIGINT) AS code, count(*) AS n FROM customer GROUP BY 2) q WHERE code < 0 AND code NOT IN (-100, -99, -98, -97, -96, -95, -90, -80, -70, -60, -50, -40)")
def _(spark, d):
    answers = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"), F.floor("c_acctbal").cast("long").alias("BALANCE"), F.when(F.col("c_custkey") % 50 == 0, -99).otherwise(F.col("c_nationkey") + 1).cast("long").alias("NATION"))
    return RC.unknown_codes(answers, ["BALANCE", "NATION"])


@query("ag_taxonomy_checks", f"{_FEATS_PRED} SELECT 'bin_size' AS \"check\", bin AS name, count(*) AS n FROM feats GROUP BY bin UNION ALL SELECT 'battery_size', battery, count(*) FROM pred JOIN batteries USING (battery_no) GROUP BY battery")
def _(spark, d):
    return RC.taxonomy_checks(_features(spark, d)[1], FX.predictions(spark, d), FX.batteries(spark), list(TX.BINS), [i[1] for i in FX.ITEMS])


_STRONG, _SOFT = ["VIEWS"], ["PARTY", "TRUST"]


@query("ag_leak_rescore", f"""{P}, f AS (SELECT rid, condition, abs_err, item, NOT (fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR pred_code = 7))) AS likert, unnest(['all', 'minus_strong', 'minus_both']) AS filter FROM p WHERE parse_ok)
 SELECT rid, condition, filter, count(*) AS n, round(avg(CAST(abs_err AS DOUBLE)) FILTER (likert), 6) AS mae, round(100 * avg(CAST(abs_err <= 1 AS DOUBLE)) FILTER (likert), 6) AS within1, round(100 * avg(CAST(abs_err = 0 AS DOUBLE)) FILTER (NOT likert), 6) AS cat_match
 FROM f WHERE NOT (filter <> 'all' AND item = 'VIEWS') AND NOT (filter = 'minus_both' AND item IN ('PARTY', 'TRUST')) GROUP BY rid, condition, filter""")
def _(spark, d):
    return RC.leak_rescore(pred(spark, d), _STRONG, _SOFT)


_TRAITS = {"trust": [("TRUST", False), ("FAIR", True), ("HELP", False)], "outlook": [("HAPPY", False), ("LIFE", True)], "views": [("VIEWS", False), ("PARTY", False)]}


@query("ag_trait_rmse", f"""{P}, x AS (SELECT rid, condition, CASE WHEN item IN ('TRUST', 'FAIR', 'HELP') THEN 'trust' WHEN item IN ('HAPPY', 'LIFE') THEN 'outlook' ELSE 'views' END AS trait, CASE WHEN item IN ('FAIR', 'LIFE') THEN hi - true_code ELSE true_code - lo END / CAST(hi - lo AS DOUBLE) AS t, CASE WHEN item IN ('FAIR', 'LIFE') THEN hi - pred_code ELSE pred_code - lo END / CAST(hi - lo AS DOUBLE) AS q
  FROM p WHERE parse_ok AND item IN ('TRUST', 'FAIR', 'HELP', 'HAPPY', 'LIFE', 'VIEWS', 'PARTY')), s AS (SELECT rid, condition, trait, avg(t) - avg(q) AS diff FROM x GROUP BY rid, condition, trait)
 SELECT rid, condition, count(*) AS n_traits, round(sqrt(avg(diff * diff)), 6) AS rmse FROM s GROUP BY rid, condition""")
def _(spark, d):
    return RC.trait_rmse(pred(spark, d), _TRAITS)


@query("wn_rank_match", f"""{_SUB}, s AS (SELECT b.player, round(sum({_W} * (a.value - c.value)), 6) AS shapley FROM sub a, (SELECT unnest([0, 1, 2, 3]) AS player) b, sub c WHERE (a.mask >> b.player) % 2 = 0 AND c.mask = a.mask + (1 << b.player) GROUP BY b.player),
 l AS (SELECT b.player, round(max(value) FILTER (mask = 15 - (1 << b.player)) - max(value) FILTER (mask = 15), 6) AS loo FROM sub, (SELECT unnest([0, 1, 2, 3]) AS player) b GROUP BY b.player),
 r AS (SELECT CAST(player AS INTEGER) AS player, loo, shapley, row_number() OVER (ORDER BY loo DESC, player) AS loo_rank, row_number() OVER (ORDER BY shapley DESC, player) AS shapley_rank FROM s JOIN l USING (player)) SELECT *, bool_and(loo_rank = shapley_rank) OVER () AS all_match FROM r""")
def _(spark, d):
    return RC.rank_match(_subsets(spark, d))


@query("ag_coverage_bins", f"{_FEATURES}, c AS (SELECT a.rid, b.bin, count(feats.var) AS n FROM answers a CROSS JOIN (SELECT unnest([{', '.join(repr(b) for b in TX.BINS)}]) AS bin) b LEFT JOIN feats ON feats.rid = a.rid AND feats.bin = b.bin GROUP BY a.rid, b.bin) SELECT bin, CAST(median(n) AS DOUBLE) AS median_answered, count(*) FILTER (n >= 1) AS n_any, count(*) AS n_respondents FROM c GROUP BY bin")
def _(spark, d):
    a, f = _features(spark, d)
    return RC.answered_per_bin(f, a, list(TX.BINS))


# --- resampling and regressions: no SQL, held to closed forms by tests -------------------------------------------------


@query("st_item_macro_boot")
def _(spark, d):
    rows = RS.item_macro(panel(spark, d), FX.MODELS, [i[1] for i in FX.ITEMS])
    return spark.createDataFrame(rows, "model string, err double, err_lo double, err_hi double, exact double, exact_lo double, exact_hi double")


@query("st_shapley_boot")
def _(spark, d):
    df = pred(spark, d).withColumn("mask", ((F.col("rid") * 7 + F.col("item_no") * 3 + F.col("cond_no")) % 16).cast("int"))
    return spark.createDataFrame(RS.shapley_intervals(df), "term string, value double, lo double, hi double")


@query("st_router_boot")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"))
    return spark.createDataFrame(RS.router_intervals(panel(spark, d), C.split(ids, 0.5)), "statistic string, value double, lo double, hi double")


@query("st_battery_loo")
def _(spark, d):
    return RS.battery_drops(pred(spark, d), FX.batteries(spark))


def _people(spark, d):
    """Answers of every respondent: balance, orders and spending as numbers, segment and nation as codes, some of them missing."""
    orders = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("rid")).agg(F.count("*").alias("n_orders"), F.avg("o_totalprice").alias("spent"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 37 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))
    return c.join(orders, "rid", "left")


def _encoded(spark, d):
    return E.encode(_people(spark, d), ["balance", "n_orders", "spent"], ["segment"])


@query("ml_encode")
def _(spark, d):
    rows, names = _encoded(spark, d)
    return rows.select("rid", *[F.round(f"x{i}", 6).alias(n.replace("=", "_")) for i, n in enumerate(names)])


def _by_item(spark, d):
    rows, names = _encoded(spark, d)
    x = [f"x{i}" for i in range(len(names))]
    t = FX.truth(spark, d).select("rid", "item", F.col("true_code").cast("double").alias("y"), "lo", "hi", "fmt")
    people = C.folds(rows, 5).join(rows.select("rid", *x), "rid")
    return t.join(people, "rid"), x


@query("ml_ridge_by_item")
def _(spark, d):
    rows, x = _by_item(spark, d)
    return E.ridge_by_item(rows, x).select("item", "fold", "n", T.r6("mae").alias("mae"))


@query("ag_r1_cost_interval")
def _(spark, d):
    """The ablation's paired cost over all items with a cluster interval, beside its point value per item in ag_r1_cost."""
    from ..operators import stats as ST

    pairs = T.pair_ablation(pred(spark, d)).groupBy("rid").agg(F.sum(F.col("other") - F.col("base")).alias("s"), F.count("*").cast("double").alias("c"))
    per_item = R.rule_cost(pred(spark, d)).agg(F.max("delta").alias("worst_item_delta"))
    return spark.createDataFrame([ST.ratio_ci(pairs, "s", "c", B=2000)], "point double, lo double, hi double, p double, n long").join(per_item)
