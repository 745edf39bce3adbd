"""Registered queries of printed tables, effects, profiles by prompt, transcripts and the supervised baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import cohorts as C
from ..operators import compare as CM
from ..operators import profiles as PF
from ..operators import stats as ST
from ..operators import tables as T
from ..operators import transcripts as TR
from ..sources import codebooks as K
from . import fixtures as FX
from .queries import _ABL, _ANSWERS, _MEANS, _PROFILE, _UNIT, ORACLE_SQL, SEGMENTS, A, P, _features, panel, pred, query

# --- printed tables ----------------------------------------------------------------------------------------------------

_BY_MODEL = lambda x: ", ".join(f"max({x}) FILTER (model = '{m}') AS {m}" for m in [*FX.MODELS, "combined"])


@query("ag_t0_pivot", f"{P}, l AS (SELECT item, condition, coalesce(model, 'combined') AS model, round(avg(err), 6) AS err FROM p GROUP BY GROUPING SETS ((item, condition, model), (item, condition))) SELECT item, condition, {_BY_MODEL('err')} FROM l GROUP BY item, condition")
def _(spark, d):
    return T.item_pivot(pred(spark, d), ["item", "condition"], FX.MODELS)


@query("ag_t1_pivot", f"{P}, l AS (SELECT item, coalesce(model, 'combined') AS model, round(avg(err), 6) AS err, count(*) AS n FROM p WHERE condition = 'Full' GROUP BY GROUPING SETS ((item, model), (item))) SELECT item, {_BY_MODEL('err')}, max(n) FILTER (model = 'combined') AS n_pairs FROM l GROUP BY item")
def _(spark, d):
    return T.item_pivot(pred(spark, d).where("condition = 'Full'"), ["item"], FX.MODELS, count=True)


@query("ag_t5_pivot", f"{P}, l AS (SELECT item, coalesce(model, 'combined') AS model, round(1 - avg(CAST(parse_ok AS INTEGER)), 6) AS fail FROM p GROUP BY GROUPING SETS ((item, model), (item))) SELECT item, {_BY_MODEL('fail')} FROM l GROUP BY item")
def _(spark, d):
    return T.parse_failure_pivot(pred(spark, d), FX.MODELS)


@query("ag_t5_policy_gap", f"{P}, m AS (SELECT rid, avg(err) AS a, avg(err) FILTER (parse_ok) AS b FROM p WHERE condition = 'Full' GROUP BY rid) SELECT round(avg(a), 6) AS conservative, round(avg(b), 6) AS optimistic, round(avg(a) - avg(b), 6) AS gap, count(a) AS n, count(b) AS n_optimistic FROM m")
def _(spark, d):
    return T.policy_gap(pred(spark, d))


# --- effects and rank tests --------------------------------------------------------------------------------------------

_CELLS = f"{A}, c AS (SELECT rid, item, model, prompt, avg(err) AS e, avg(exact0) AS x, count(*) AS n FROM p GROUP BY rid, item, model, prompt)"


@query("ag_main_effects", f"{_CELLS}, f AS (SELECT rid, 'model' AS factor, model AS level, e, x, n FROM c UNION ALL SELECT rid, 'prompt', prompt, e, x, n FROM c), r AS (SELECT rid, factor, level, avg(e) AS e, avg(x) AS x, sum(n) AS n FROM f GROUP BY rid, factor, level) SELECT factor, level, round(avg(e), 6) AS err, round(avg(x), 6) AS exact, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_respondents FROM r GROUP BY factor, level")
def _(spark, d):
    return T.main_effects(panel(spark, d))


@query("ag_main_effect_intervals")
def _(spark, d):
    return T.main_effect_intervals(panel(spark, d))


@query("ag_item_difficulty", f"""{_CELLS}, r AS (SELECT item, rid, avg(e) AS e, avg(x) AS x, sum(n) AS n FROM c GROUP BY item, rid), i AS (SELECT item, avg(e) AS e, avg(x) AS x, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_respondents FROM r GROUP BY item),
 b AS (SELECT item, CAST(max(n) AS DOUBLE) / sum(n) AS base, CAST(sum(n) AS BIGINT) AS n_truth FROM (SELECT item, true_code, count(*) AS n FROM truth GROUP BY item, true_code) q GROUP BY item)
 SELECT i.item, hi - lo + 1 AS k, round(e, 6) AS err, round(x, 6) AS exact, round(base, 6) AS maj_em, round(CAST(1 AS DOUBLE) / (hi - lo + 1), 6) AS uniform_em, round((x - base) / (1 - base), 6) AS lift_maj, n, n_respondents, n_truth FROM i JOIN b ON b.item = i.item JOIN items ON items.item = i.item""")
def _(spark, d):
    return T.item_difficulty(panel(spark, d), FX.truth(spark, d))


@query("ag_item_difficulty_intervals")
def _(spark, d):
    return T.item_difficulty_intervals(panel(spark, d), FX.truth(spark, d))


@query("st_wilcoxon_test")
def _(spark, d):
    """The signed-rank test of what dropping the attitudinal features costs, with its exact or normal p."""
    pairs = T.pair_conditions(pred(spark, d)).where("condition = 'drop_attitudinal'")
    return ST.wilcoxon_test(pairs.select("rid", T.r6("delta").alias("delta")))


@query("st_wilcoxon_counts", f"{_MEANS}, dd AS (SELECT round(delta, 6) AS delta FROM pairs WHERE condition = 'drop_attitudinal') SELECT count(*) FILTER (delta <> 0) AS n, count(*) FILTER (delta = 0) AS n_zero, round(CAST(count(*) FILTER (delta < 0) AS DOUBLE) / count(*), 6) AS share_better, round(avg(delta), 6) AS mean FROM dd")
def _(spark, d):
    pairs = T.pair_conditions(pred(spark, d)).where("condition = 'drop_attitudinal'")
    return ST.wilcoxon_test(pairs.select("rid", T.r6("delta").alias("delta")), B=20).select("n", "n_zero", T.r6("share_better").alias("share_better"), T.r6("mean").alias("mean"))


# --- cells, arms and policies ------------------------------------------------------------------------------------------

_SOME = ["Full", "drop_demographic", "drop_attitudinal"]
_IN = ", ".join(f"'{c}'" for c in _SOME)


@query("jn_common_in_all", f"{P}, ok AS (SELECT rid FROM p WHERE condition IN ({_IN}) AND parse_ok AND item = 'VIEWS' GROUP BY rid HAVING count(DISTINCT condition) = 3) SELECT condition, count(*) AS n, round(avg(err), 6) AS err FROM p WHERE condition IN ({_IN}) AND rid IN (SELECT rid FROM ok) GROUP BY condition")
def _(spark, d):
    """Errors by condition over the respondents whose views were parsed in all of three conditions."""
    df = pred(spark, d)
    ids = CM.common_respondents(df.where("item = 'VIEWS'"), _SOME, "err_opt")
    return df.where(F.col("condition").isin(*_SOME)).join(ids, "rid", "left_semi").groupBy("condition").agg(F.count("*").alias("n"), T.r6(F.avg("err")).alias("err"))


@query("ag_item_profile", f"""{A}, pr AS ({_PROFILE.format('model, prompt')}), v AS (SELECT model, prompt, item, var_pop(m) AS v FROM (SELECT model, prompt, item, rid, avg(CAST(pred_code AS DOUBLE)) AS m FROM p WHERE parse_ok GROUP BY model, prompt, item, rid) q GROUP BY model, prompt, item),
 h AS (SELECT item, round(var_pop(CAST(true_code AS DOUBLE)), 6) AS h FROM truth GROUP BY item) SELECT pr.*, round(v / h, 6) AS var_ratio FROM pr JOIN v ON v.model = pr.model AND v.prompt = pr.prompt AND v.item = pr.item JOIN h ON h.item = pr.item""")
def _(spark, d):
    return CM.item_profile_with_variance(panel(spark, d), ["model", "prompt"], T.human_variance(FX.truth(spark, d)))


@query("ag_cell_normalized_mae", f"{A}, m AS (SELECT model, prompt, rid, avg(err) AS a, avg(err) FILTER (parse_ok) AS b FROM p GROUP BY model, prompt, rid) SELECT model, prompt, round(avg(a), 6) AS macro, count(a) AS n, round(avg(b), 6) AS optimistic, count(b) AS n_optimistic FROM m GROUP BY model, prompt")
def _(spark, d):
    return CM.cell_errors(panel(spark, d), ["model", "prompt"])


_ARMS = ["panel", "on", "off"]


def _arms(spark, d):
    """The first prompt of three models as the panel, the anchor's first prompt with the rule on and its second with the rule off, on a cohort of respondents."""
    arm = F.when((F.col("model") != "cheap_d") & (F.col("prompt") == "P1"), "panel").when((F.col("model") == "cheap_d") & (F.col("prompt") == "P1"), "on").when((F.col("model") == "cheap_d") & (F.col("prompt") == "P2"), "off")
    return panel(spark, d).where("rid % 4 = 0").withColumn("arm", arm).where("arm is not null")


_ARM_SQL = f"{A}, a AS (SELECT *, CASE WHEN model <> 'cheap_d' AND prompt = 'P1' THEN 'panel' WHEN model = 'cheap_d' AND prompt = 'P1' THEN 'on' WHEN model = 'cheap_d' AND prompt = 'P2' THEN 'off' END AS arm FROM p WHERE rid % 4 = 0)"
_ARM_COLUMNS = ", ".join(f"round(max(em) FILTER (arm = '{a}'), 6) AS em_{a}, round(max(err) FILTER (arm = '{a}'), 6) AS err_{a}, CAST(max(n) FILTER (arm = '{a}') AS BIGINT) AS n_{a}" for a in _ARMS)


@query("ag_anchor_arms", f"{_ARM_SQL}, m AS (SELECT item, arm, model, sum(exact0) FILTER (parse_ok) AS hit, count(*) FILTER (parse_ok) AS ok, avg(err) AS e FROM a WHERE arm IS NOT NULL GROUP BY item, arm, model), c AS (SELECT item, arm, sum(hit) / sum(ok) AS em, avg(e) AS err, sum(ok) AS n FROM m GROUP BY item, arm) SELECT item, {_ARM_COLUMNS} FROM c GROUP BY item")
def _(spark, d):
    return CM.arms_by_item(_arms(spark, d), _ARMS)


@query("ag_anchor_pooled", f"""{_ARM_SQL}, t AS (SELECT item, true_code, count(*) AS n FROM truth WHERE rid % 4 = 0 GROUP BY item, true_code), k AS (SELECT item, max(n) AS top, sum(n) AS n FROM t GROUP BY item)
 SELECT arm, round(sum(exact0) FILTER (parse_ok) / count(*) FILTER (parse_ok), 6) AS em, count(*) FILTER (parse_ok) AS n FROM a WHERE arm IS NOT NULL GROUP BY arm UNION ALL SELECT 'majority', round(CAST(sum(top) AS DOUBLE) / sum(n), 6), CAST(sum(n) AS BIGINT) FROM k""")
def _(spark, d):
    return CM.pooled_arms(_arms(spark, d), FX.truth(spark, d).where("rid % 4 = 0"))


_METRICS = ["likert_mae", "within1", "cat_match", "parse_failure", "self_consistency"]


@query("ag_arm_metrics", f"WITH m AS (SELECT * FROM ({ORACLE_SQL['ag_respondent_condition']}) q) SELECT model, prompt, count(*) AS n_respondents, {', '.join(f'round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_sd, count({m}) AS {m}_n' for m in _METRICS)} FROM m GROUP BY model, prompt")
def _(spark, d):
    return CM.arm_summary(T.respondent_condition(panel(spark, d)), ["model", "prompt"], _METRICS)


@query("st_battery_items", f"{_ABL}, n AS (SELECT battery_no, count(*) AS n FROM ab GROUP BY battery_no) SELECT battery, bin, item, round(avg(other - base), 6) AS delta, count(*) AS n_pairs, round(sum(other - base) / max(n), 6) AS share FROM ab JOIN n ON n.battery_no = ab.battery_no JOIN batteries ON batteries.battery_no = ab.battery_no GROUP BY battery, bin, item")
def _(spark, d):
    return CM.battery_items(pred(spark, d), FX.batteries(spark))


@query("st_router_exact", f"""{A}, parts AS (SELECT c_custkey AS rid, CASE WHEN {_UNIT.format('c_custkey')} < {2**31} THEN 'train' ELSE 'test' END AS part FROM customer),
 r AS (SELECT item, model, sum(exact0) FILTER (part = 'train') AS a, count(*) FILTER (part = 'train') AS na, sum(exact0) FILTER (part = 'test') AS b, count(*) FILTER (part = 'test') AS nb FROM p JOIN parts USING (rid) GROUP BY item, model),
 s AS (SELECT model, sum(b) / sum(nb) AS single, row_number() OVER (ORDER BY sum(a) / sum(na) DESC, model) AS rk FROM r GROUP BY model),
 i AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY a / na DESC, model) AS r1, row_number() OVER (PARTITION BY item ORDER BY b / nb DESC, model) AS r2 FROM r),
 g AS (SELECT sum(b) FILTER (r1 = 1) / sum(nb) FILTER (r1 = 1) AS routed, sum(b) FILTER (r2 = 1) / sum(nb) FILTER (r2 = 1) AS oracle FROM i)
 SELECT model AS best_single, round(routed, 6) AS routed, round(single, 6) AS single, round(oracle, 6) AS oracle, round(routed - single, 6) AS gain FROM g, s WHERE rk = 1""")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"))
    return CM.router(panel(spark, d), C.split(ids, 0.5), "exact0", highest=True)


@query("ag_databook_intervals")
def _(spark, d):
    return CM.databook_intervals(panel(spark, d), B=300)


@query("ag_multimodel_intervals")
def _(spark, d):
    return CM.multimodel_intervals(panel(spark, d), FX.MODELS)


# --- profiles by prompt ------------------------------------------------------------------------------------------------

_NAMES = [("SEGMENT", "market segment "), ("NATION", "nation")]
_TEMPLATES = [("SEGMENT", "I buy for the {val_lower} trade.", "Which trade do you buy for?"), ("BALANCE", "My balance is coded {val_int}, which reads {val}.", None)]
PROMPTS = {
    "kv": PF.Prompt("kv", "A customer said this.", {"demographic": "## WHO", "behavioral": "## WHAT", "psychological": "## HOW", "attitudinal": "## WHY"}),
    "prose": PF.Prompt("prose", "I am a customer.", {"demographic": "## WHO I AM", "behavioral": "## WHAT I DO", "psychological": "## HOW I STAND"}),
    "qa": PF.Prompt("qa", "An interview with a customer.", {"demographic": "## WHO", "psychological": "## HOW", "behavioral": "## WHAT"}),
}
_SHOWN = "CASE WHEN label = upper(label) AND label <> lower(label) THEN upper(substr(label, 1, 1)) || lower(substr(label, 2)) ELSE label END"
_LABELLED = f"""WITH {_ANSWERS}, f AS (SELECT rid, 'SEGMENT' AS var, 'market segment' AS name, SEGMENT AS code, upper(substr(s, 1, 1)) || lower(substr(s, 2)) AS label, 'behavioral' AS bin FROM (SELECT rid, SEGMENT, [{', '.join(repr(s) for s in SEGMENTS)}][SEGMENT] AS s FROM answers WHERE SEGMENT BETWEEN 1 AND 5) q
 UNION ALL SELECT rid, 'NATION', 'nation', NATION, n_name, 'demographic' FROM answers JOIN nation ON n_nationkey + 1 = NATION UNION ALL SELECT rid, 'BALANCE', 'BALANCE', BALANCE, CASE BALANCE WHEN 1 THEN 'IN DEBT' ELSE '2' END, 'psychological' FROM answers)"""
_LINES = {
    "kv": f"'- ' || name || ': ' || {_SHOWN}",
    "prose": "CASE var WHEN 'SEGMENT' THEN 'I buy for the ' || lower(label) || ' trade.' WHEN 'BALANCE' THEN 'My balance is coded ' || code || ', which reads ' || label || '.' ELSE 'On ' || name || ', I would say ' || lower(label) || '.' END",
    "qa": f"'Interviewer: ' || CASE var WHEN 'SEGMENT' THEN 'Which trade do you buy for?' ELSE 'What about ' || name || '?' END || chr(10) || 'Respondent: ' || {_SHOWN} || '.'",
}


def _labelled(spark, d, **more):
    answers = _features(spark, d)[0]
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.lit("NATION").alias("var"), (F.col("n_nationkey") + 1).cast("long").alias("code"), F.col("n_name").alias("label"))
    own = [("SEGMENT", i + 1, s.title()) for i, s in enumerate(SEGMENTS)] + [("SEGMENT", 8, "No answer"), ("BALANCE", 1, "IN DEBT (Please specify)"), ("BALANCE", 2, "2.0")]
    labels = nations.unionByName(spark.createDataFrame(own, "var string, code long, label string"))
    bins = spark.createDataFrame([("SEGMENT", "behavioral"), ("NATION", "demographic"), ("BALANCE", "psychological")], "var string, bin string")
    return answers, PF.features_labelled(answers, ["SEGMENT", "NATION", "BALANCE"], labels, bins, spark.createDataFrame(_NAMES, "var string, label string"), **more)


def _profile_sql(style: str, where: str = "TRUE") -> str:
    prompt, line = PROMPTS[style], _LINES[style]
    blocks = " || ".join(f"coalesce(chr(10) || '{prompt.headers[b]}' || chr(10) || string_agg({line}, chr(10) ORDER BY var) FILTER (bin = '{b}') || chr(10), '')" for b in PF.BINS if b in prompt.headers)
    counts = ", ".join(f"count(*) FILTER (bin = '{b}') AS n_{b}" for b in PF.BINS)
    return f"""{_LABELLED}, r AS (SELECT a.rid, '{prompt.preamble}' || chr(10) || {blocks} AS profile, count(var) AS feature_count, {counts} FROM answers a LEFT JOIN (SELECT * FROM f WHERE {where}) g ON g.rid = a.rid GROUP BY a.rid)
 SELECT *, CAST(length(profile) AS BIGINT) AS char_count, CAST(length(profile) // 4 AS BIGINT) AS approx_tokens FROM r"""


def _render(style: str, **more):
    def run(spark, d):
        people, features = _labelled(spark, d, **more)
        return PF.render(features, people, PROMPTS[style], spark.createDataFrame(_TEMPLATES, "var string, sentence string, question string"))

    return run


for _style in PROMPTS:
    query(f"txt_prompt_{_style}", _profile_sql(_style))(_render(_style))
query("txt_prompt_dropped_bin", _profile_sql("prose", "bin <> 'behavioral'"))(_render("prose", drop_bin="behavioral"))
query("txt_prompt_empty", _profile_sql("kv", "FALSE"))(_render("kv", exclude=("SEGMENT", "NATION", "BALANCE")))

# --- transcripts -------------------------------------------------------------------------------------------------------

_WORDS = ["one", "two", "three", "four", "five", "six", "seven"]
_TOKEN = lambda w: f"(^|[ ,.\\n]){w}([ ,.\\n]|$)"
_CONFIRM, _REPROMPT = f"(?i){_TOKEN('(is|est|ist|es)')}", f"(?i){_TOKEN('(of|der|la|las)')}"
_ORDERED = [("with que", "que"), ("with th", "th")]
_CHOICE = [("in", _TOKEN("in")), ("en", _TOKEN("en")), ("any e", "e")]
_TALK = {"A": (_TOKEN("(the|die|le|el)"), ("scale", 5)), "B": ("que|sch", ("ordered", _ORDERED)), "C": ("[aeiou]n ", ("categorical", _CHOICE))}


def _sql(text: str) -> str:
    return "'" + text.replace("\\n", "' || chr(10) || '") + "'"


def _first(text: str, options) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i)' || {_sql(rx)}) THEN '{label}'" for label, rx in options) + " END"


_SCALE = lambda text: f"list_filter(list_transform(regexp_split_to_array(lower({text}), '[^0-9a-zß-ÿ_]+'), lambda x: list_position([{', '.join(repr(w) for w in _WORDS)}], x)), lambda n: n BETWEEN 1 AND 5)[-1]"
_TALK_SQL = f"""WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text || ' ' || [{', '.join(repr(w) for w in _WORDS)}][(conv_id + turn) % 7 + 1] AS text FROM conversations),
 i AS (SELECT conv_id, item, min(turn) AS anchor FROM ({' UNION ALL '.join(f"SELECT conv_id, turn, '{i}' AS item FROM t WHERE role = 'assistant' AND regexp_matches(text, '(?i)' || {_sql(rx)})" for i, (rx, _) in _TALK.items())}) q GROUP BY conv_id, item),
 w AS (SELECT i.conv_id, i.item, anchor, turn, role, text FROM i JOIN t ON t.conv_id = i.conv_id AND turn > anchor AND turn <= anchor + 15),
 e AS (SELECT conv_id, item, min(turn) AS stop FROM w WHERE role <> 'user' AND (regexp_matches(text, {_sql(_CONFIRM)}) OR NOT regexp_matches(text, {_sql(_REPROMPT)})) GROUP BY conv_id, item),
 u AS (SELECT w.conv_id, w.item, count(*) AS n_turns, string_agg(text, ' ' ORDER BY turn) AS said FROM w LEFT JOIN e ON e.conv_id = w.conv_id AND e.item = w.item WHERE role = 'user' AND (stop IS NULL OR turn < stop) GROUP BY w.conv_id, w.item),
 c AS (SELECT e.conv_id, e.item, coalesce(nullif(regexp_extract(text, '^(.+?[.!?])(?:\\s|$)', 1), ''), text) AS confirmation FROM e JOIN t ON t.conv_id = e.conv_id AND t.turn = e.stop WHERE regexp_matches(text, {_sql(_CONFIRM)})),
 r AS (SELECT i.*, coalesce(n_turns, 0) AS n_turns, coalesce(said, '') AS said, confirmation FROM i LEFT JOIN u ON u.conv_id = i.conv_id AND u.item = i.item LEFT JOIN c ON c.conv_id = i.conv_id AND c.item = i.item)
 SELECT *, CASE item WHEN 'A' THEN CAST(coalesce({_SCALE('confirmation')}, {_SCALE('said')}) AS VARCHAR) WHEN 'B' THEN coalesce({_first('confirmation', _ORDERED)}, {_first('said', _ORDERED)}) ELSE coalesce({_first('said', _CHOICE)}, {_first('confirmation', _CHOICE)}) END AS value FROM r"""


@query("txt_transcript_answers", _TALK_SQL)
def _(spark, d):
    """Conversations whose turns end in a number word, asked for a scale, an ordered list and a category."""
    word = F.element_at(F.array(*map(F.lit, _WORDS)), ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    turns = spark.read.parquet(f"{d}/conversations.parquet").withColumn("text", F.concat("text", F.lit(" "), word))
    return TR.transcript_answers(turns, _TALK, _CONFIRM, _REPROMPT)


_PICKS = [("http", "https?://"), ("licence", "licen[cs]e"), ("copyright", "copyright|\\(c\\)")]
_NAMED = ["license", "copyright", "http", "the", "que", "die"]


@query("txt_option_extract", f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, lower(coalesce(text, '')) AS low FROM documents), o AS (SELECT doc_id, o, strpos(low, o) AS place FROM t, (SELECT unnest([{', '.join(repr(o) for o in _NAMED)}]) AS o) q WHERE strpos(low, o) > 0),
 k AS (SELECT doc_id, o, row_number() OVER (PARTITION BY doc_id ORDER BY place DESC, o DESC) AS n FROM o) SELECT t.doc_id, {_first('text', _PICKS)} AS first, k.o AS latest FROM t LEFT JOIN k ON k.doc_id = t.doc_id AND n = 1""")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", TR.first_match(F.col("text"), _PICKS).alias("first"), TR.latest_option(F.col("text"), _NAMED).alias("latest"))


@query("ag_uncovered_codes", f"WITH {FX.TRUTH_SQL} SELECT item AS var, true_code AS code, count(*) AS n FROM truth WHERE (item = 'VIEWS' AND true_code NOT IN (1, 2, 3, 4, 5)) OR (item = 'HELP' AND true_code NOT IN (1, 3, 5)) GROUP BY item, true_code")
def _(spark, d):
    answers = FX.truth(spark, d).select(F.col("item").alias("var"), F.col("true_code").alias("code"))
    return K.uncovered_codes(answers, {"VIEWS": [1, 2, 3, 4, 5], "HELP": [1, 3, 5], "PRAY": [1, 2]})


# --- the supervised baseline -------------------------------------------------------------------------------------------

_MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13)][:80]
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Variables of the battery that an item belongs to: they do not predict it.
HIDDEN = {"PARTY": ["nation"], "VIEWS": ["segment", "balance"], "TRUST": [f"p{i}" for i in range(5)], "HELP": ["balance", "first_month"], "GUNS": [f"n_{m}" for m in _MONTHS[:12]]}
TREATMENT = {i: "logistic" if fmt == "binary" else "ridge" for _, i, _, _, fmt in FX.ITEMS}


def people_wide(spark, d):
    """Respondents with numbers (balance, orders and mean prices by month, orders by priority) and codes (nation, segment, first month): about 280 model columns."""
    month = F.date_format("o_orderdate", "yyyy-MM")
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("rid"), month.alias("m"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("p"))
    by = [F.count_if(F.col("m") == x).alias(f"n_{x}") for x in _MONTHS] + [F.avg(F.when(F.col("m") == x, F.col("price"))).alias(f"s_{x}") for x in _MONTHS] + [F.count_if(F.col("p") == x).alias(f"p{i}") for i, x in enumerate(_PRIORITIES)]
    sums = orders.groupBy("rid").agg(*by, F.min("m").alias("first_month"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("balance"), F.when(F.col("c_custkey") % 37 != 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("nation"))
    people = c.join(sums, "rid", "left")
    return people.join(C.folds(c.select("rid"), 5), "rid"), ["balance", *[f"n_{m}" for m in _MONTHS], *[f"s_{m}" for m in _MONTHS], *[f"p{i}" for i in range(5)]], ["nation", "segment", "first_month"]


def _baseline(spark, d, items=None):
    people, numeric, nominal = people_wide(spark, d)
    truths = FX.truth(spark, d).select("rid", "item", F.col("true_code").cast("double").alias("y"))
    return B.regression_baseline(people, truths, items or TREATMENT, numeric, nominal, HIDDEN)


@query("ml_ridge_logistic")
def _(spark, d):
    """The whole baseline: every item and fold, over all features outside the item's battery."""
    return _baseline(spark, d)


@query("ml_logistic")
def _(spark, d):
    """The two-option items alone."""
    return _baseline(spark, d, {i: t for i, t in TREATMENT.items() if t == "logistic"})


@query("ag_t4_vs_baseline")
def _(spark, d):
    """T4 on the headline cohort: everyone but the 200 sampled respondents; the baseline is fitted on all."""
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"))
    full = C.exclude_cohort(pred(spark, d).where("condition = 'Full'"), C.sample_respondents(ids, 200))
    spans = FX.items(spark).select("item", (F.col("hi") - F.col("lo")).cast("double").alias("span"))
    return B.versus_baseline(full.select("item", "err"), B.item_means(_baseline(spark, d)), spans)


@query("ag_t4_model_side", f"{P}, s AS (SELECT c_custkey AS rid FROM customer ORDER BY sha256('42|' || c_custkey) LIMIT 200) SELECT item, round(avg(err), 6) AS err, count(*) AS n_pairs FROM p WHERE condition = 'Full' AND rid NOT IN (SELECT rid FROM s) GROUP BY item")
def _(spark, d):
    """The part of T4 that SQL can check: the model's error on the headline cohort, an item without a baseline abstaining."""
    ids = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid"))
    full = C.exclude_cohort(pred(spark, d).where("condition = 'Full'"), C.sample_respondents(ids, 200))
    none = spark.createDataFrame([], "item string, mae double, n_folds long, reason string")
    return B.versus_baseline(full.select("item", "err"), none, FX.items(spark).select("item", F.lit(1.0).alias("span"))).select("item", T.r6("err").alias("err"), "n_pairs")
