"""Joins and aggregations over the long prediction table.

Columns: rid, model, prompt, condition, item, lo, hi, fmt, sample, true_code, pred_code, parse_ok, abs_err.  Everything keyed by item,
model, prompt or condition aggregates map-side; only respondent-level means shuffle by rid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import stats as ST


def r6(x: Column) -> Column:
    """Six places, whatever the order of a sum: the noise of its last bits is rounded off first, so exact halves always go up."""
    return F.round(F.round(x, 12), 6)


def scored(df: DataFrame) -> DataFrame:
    """Adds err (conservative), err_opt (optimistic), exact0 (failures 0) and exact (failures null)."""
    c = F.col
    zero, hit = S.exact_match(c("true_code"), c("pred_code"), c("parse_ok"))
    return df.select(
        "*",
        S.normalized_error(c("abs_err"), c("lo"), c("hi"), c("parse_ok")).alias("err"),
        S.optimistic_error(c("abs_err"), c("lo"), c("hi"), c("parse_ok")).alias("err_opt"),
        zero.alias("exact0"),
        hit.alias("exact"),
    )


def respondent_macro(df: DataFrame, by: list[str], value: str = "err") -> DataFrame:
    """Mean within respondent, then over respondents: (by, macro, n)."""
    return df.groupBy("rid", *by).agg(F.avg(value).alias("m")).where("m is not null").groupBy(*by).agg(r6(F.avg("m")).alias("macro"), F.count("*").alias("n"))


def pair_conditions(df: DataFrame, base: str = "Full", value: str = "err") -> DataFrame:
    """Respondent means of every other condition beside the base, from one aggregation by respondent: (rid, condition, base, other, delta)."""
    means = df.groupBy("rid", "condition").agg(F.avg(value).alias("m")).where("m is not null")
    both = means.groupBy("rid").agg(F.max(F.when(F.col("condition") == base, F.col("m"))).alias("base"), F.collect_list(F.struct("condition", "m")).alias("all"))
    each = both.where("base is not null").select("rid", "base", F.explode("all").alias("x")).where(F.col("x.condition") != base)
    return each.select("rid", "x.condition", "base", F.col("x.m").alias("other"), (F.col("x.m") - F.col("base")).alias("delta"))


def pair_ablation(df: DataFrame, ablated: str = "random_battery_drop", base: str = "Full", value: str = "err") -> DataFrame:
    """Rows (rid, item, battery_no, base, other), and the ablated arm's model where there is one, parsed in both arms, from one aggregation.

    There is one row for each respondent, item and condition.
    """
    more = [c for c in ("battery_no", "model") if c in df.columns]
    arm = lambda c, *cols: F.max(F.when(F.col("condition") == c, F.struct(*cols)))
    rows = df.where(F.col("parse_ok") & F.col("condition").isin(ablated, base)).groupBy("rid", "item")
    rows = rows.agg(arm(base, value).alias("a"), arm(ablated, value, *more).alias("b")).where("a is not null and b is not null")
    return rows.select("rid", "item", *[f"b.{c}" for c in more], F.col(f"a.{value}").alias("base"), F.col(f"b.{value}").alias("other"))


def _columns() -> Column:
    """The model's own column and the combined one."""
    return F.explode(F.array(F.col("model"), F.lit("combined")))


def bin_deltas(df: DataFrame, base: str = "Full") -> DataFrame:
    """(rid, column, condition, delta): respondent means of each dropped group less the base, by model and for all models together."""
    cells = df.groupBy("rid", "condition", "model").agg(F.sum("err").alias("s"), F.count("err").alias("n")).withColumn("column", _columns())
    means = cells.groupBy("rid", "column", "condition").agg((F.sum("s") / F.sum("n")).alias("m")).where("m is not null")
    both = means.groupBy("rid", "column").agg(F.max(F.when(F.col("condition") == base, F.col("m"))).alias("base"), F.collect_list(F.struct("condition", "m")).alias("all"))
    each = both.where("base is not null").select("rid", "column", "base", F.explode("all").alias("x")).where(F.col("x.condition").startswith("drop_"))
    return each.select("rid", "column", "x.condition", (F.col("x.m") - F.col("base")).alias("delta"))


def bin_columns(df: DataFrame) -> DataFrame:
    return bin_deltas(df).groupBy("condition", "column").agg(r6(F.avg("delta")).alias("delta"), F.count("*").alias("n"))


def bin_intervals(df: DataFrame, B: int = 1000) -> DataFrame:
    """T2: every dropped group's error delta by column with interval, p and Holm p over the groups of the column."""
    rows = ST.ratio_intervals(bin_deltas(df).withColumn("one", F.lit(1.0)), ["condition", "column"], "delta", "one", B=B)
    return holm(rows, ["column"], key="condition").select("condition", "column", F.col("point").alias("delta"), "lo", "hi", "p", F.col("p_adj").alias("p_holm"), "n")


def battery_pairs(df: DataFrame) -> DataFrame:
    """(rid, item, battery_no, column, delta) of pairs parsed in both arms."""
    return pair_ablation(df).select("rid", "item", "battery_no", _columns().alias("column"), (F.col("other") - F.col("base")).alias("delta"))


def battery_columns(df: DataFrame, batteries: DataFrame) -> DataFrame:
    """Pair-level mean delta by battery and column, with counts and the battery's rank by the combined delta."""
    out = battery_pairs(df).groupBy("battery_no", "column").agg(r6(F.avg("delta")).alias("delta"), F.count("*").alias("n_pairs"), F.countDistinct("rid").alias("n_respondents"), F.countDistinct("item").alias("n_items"))
    out = out.join(batteries.select("battery_no", "battery"), "battery_no").drop("battery_no")
    rank = F.row_number().over(Window.orderBy(F.desc("delta"), "battery")).cast("long")  # one row for each battery
    order = out.where(F.col("column") == "combined").select("battery", rank.alias("rank"))
    return out.join(order, "battery")


def battery_intervals(df: DataFrame, batteries: DataFrame, B: int = 1000) -> DataFrame:
    """T3: the columns of `battery_columns` with intervals of the pair-level mean, respondents resampled."""
    sums = battery_pairs(df).groupBy("rid", "battery_no", "column").agg(F.sum("delta").alias("s"), F.count("*").cast("double").alias("c"))
    ci = ST.ratio_intervals(sums, ["battery_no", "column"], "s", "c", B=B).join(batteries.select("battery_no", "battery"), "battery_no")
    return battery_columns(df, batteries).join(ci.select("battery", "column", "lo", "hi"), ["battery", "column"])


def headline_intervals(df: DataFrame, B: int = 1000) -> DataFrame:
    """Respondent-macro error of every condition with its interval, and paired deltas to the base with interval and p (delta null for the base)."""
    means = df.groupBy("rid", "condition").agg(F.avg("err").alias("m")).where("m is not null").withColumn("one", F.lit(1.0))
    level = ST.ratio_intervals(means, ["condition"], "m", "one", B=B).select("condition", F.col("point").alias("macro"), "lo", "hi", "n")
    delta = ST.ratio_intervals(pair_conditions(df).withColumn("one", F.lit(1.0)), ["condition"], "delta", "one", B=B)
    return level.join(delta.select("condition", F.col("point").alias("delta"), F.col("lo").alias("delta_lo"), F.col("hi").alias("delta_hi"), "p"), "condition", "left")


def condition_metrics(df: DataFrame) -> DataFrame:
    """(condition, metric, respondent_macro, item_macro, pooled, n) of likert error, within-1 and category match on parsed answers."""
    kind = S.treatment(F.col("fmt"), F.col("true_code"), F.col("pred_code"))
    likert, nominal = F.col("parse_ok") & (kind == "likert"), F.col("parse_ok") & (kind == "categorical")
    each = [("likert_mae", likert, F.col("abs_err").cast("double")), ("within1", likert, (F.col("abs_err") <= 1).cast("double")), ("cat_match", nominal, (F.col("abs_err") == 0).cast("double"))]
    rows = df.select("condition", "rid", "item", F.explode(F.array_compact(F.array(*[F.when(ok, F.struct(F.lit(name).alias("metric"), v.alias("v"))) for name, ok, v in each]))).alias("x")).select("condition", "rid", "item", "x.*")
    cell = rows.groupBy("condition", "metric", "rid", "item").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    macro = cell.groupBy("condition", "metric", "rid").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy("condition", "metric").agg(r6(F.avg("m")).alias("respondent_macro"))
    items = cell.groupBy("condition", "metric", "item").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).groupBy("condition", "metric")
    return macro.join(items.agg(r6(F.avg(F.col("s") / F.col("n"))).alias("item_macro"), r6(F.sum("s") / F.sum("n")).alias("pooled"), F.sum("n").alias("n")), ["condition", "metric"])


def bin_delta(df: DataFrame) -> DataFrame:
    return pair_conditions(df).where(F.col("condition").startswith("drop_")).groupBy("condition").agg(r6(F.avg("delta")).alias("delta"), F.count("*").alias("n"))


def battery_delta(df: DataFrame, batteries: DataFrame) -> DataFrame:
    """Pair-level mean delta by battery with pair, respondent and item counts."""
    pairs = pair_ablation(df).join(batteries, "battery_no")
    return pairs.groupBy("battery", "bin").agg(r6(F.avg(F.col("other") - F.col("base"))).alias("delta"), F.count("*").alias("n_pairs"), F.countDistinct("rid").alias("n_respondents"), F.countDistinct("item").alias("n_items"))


def missing_pairs(df: DataFrame, ablated: str = "random_battery_drop", base: str = "Full") -> DataFrame:
    both = df.where(F.col("condition").isin(ablated, base)).groupBy("rid", "item").agg(F.bool_and("parse_ok").alias("both"), F.min(F.when(F.col("condition") == base, F.col("parse_ok").cast("int"))).alias("a"), F.min(F.when(F.col("condition") == ablated, F.col("parse_ok").cast("int"))).alias("b"))
    both = both.where("a is not null and b is not null")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("both")).alias("both_parsed"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("base_failed"), F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("ablated_failed"))


def random_column(df: DataFrame, models: list[str], seed: str = "42") -> DataFrame:
    """The synthetic model Random: the rows of the model that a hash picks per respondent and prompt. No join."""
    if df.select("condition").distinct().count() > 1:
        raise ValueError("a Random column is defined for tables of one condition")
    pick = S.hash_pick(F.concat_ws("|", F.lit(seed), F.col("rid").cast("string"), F.col("prompt")), F.lit(len(models)))
    chosen = F.element_at(F.array(*map(F.lit, models)), (pick + 1).cast("int"))
    return df.where(F.col("model") == chosen).withColumn("model", F.lit("Random"))


def item_table(df: DataFrame, by: list[str]) -> DataFrame:
    """T0 and T1: mean errors by item and more, with the combined column (model = 'combined') from one pass."""
    ok = df.groupingSets([[F.col("item"), F.col("condition"), F.col("model")], [F.col("item"), F.col("condition")]], "item", "condition", "model")
    out = ok.agg(r6(F.avg("err")).alias("err"), F.count("*").alias("n")).withColumn("model", F.coalesce("model", F.lit("combined")))
    return out.select(*by, "err", "n")


def parse_failures(df: DataFrame) -> DataFrame:
    return df.groupBy("item", "model").agg(r6(1 - F.avg(F.col("parse_ok").cast("double"))).alias("parse_fail"), F.count("*").alias("n"))


def item_pivot(df: DataFrame, by: list[str], models: list[str], count: bool = False) -> DataFrame:
    """T0 and T1 as they are printed: a column of mean errors for each model and one for all together; with `count` the rows behind the latter."""
    long = item_table(df, [*by, "model"])
    out = long.groupBy(*by).pivot("model", [*models, "combined"]).agg(F.first("err"))
    return out.join(long.where("model = 'combined'").select(*by, F.col("n").alias("n_pairs")), by) if count else out


def parse_failure_pivot(df: DataFrame, models: list[str]) -> DataFrame:
    """T5: the share of answers that could not be parsed, by item with a column for each model and one for all together."""
    sets = df.groupingSets([[F.col("item"), F.col("model")], [F.col("item")]], "item", "model")
    rate = sets.agg(r6(1 - F.avg(F.col("parse_ok").cast("double"))).alias("fail")).withColumn("model", F.coalesce("model", F.lit("combined")))
    return rate.groupBy("item").pivot("model", [*models, "combined"]).agg(F.first("fail"))


def policy_gap(df: DataFrame, condition: str = "Full") -> DataFrame:
    """One row: the respondent-macro error of a condition with failures as misses and with failures left out, the gap, and the respondents of each."""
    means = df.where(F.col("condition") == condition).groupBy("rid").agg(F.avg("err").alias("a"), F.avg("err_opt").alias("b"))
    return means.agg(r6(F.avg("a")).alias("conservative"), r6(F.avg("b")).alias("optimistic"), r6(F.avg("a") - F.avg("b")).alias("gap"), F.count("a").alias("n"), F.count("b").alias("n_optimistic"))


def respondent_condition(df: DataFrame) -> DataFrame:
    """Per respondent and condition: likert MAE, within-1 %, category match %, parse failure %, self-consistency % of samples 1 and 2."""
    kind = S.treatment(F.col("fmt"), F.col("true_code"), F.col("pred_code"))
    df = df.withColumn("likert", (kind == "likert") & F.col("parse_ok")).withColumn("nominal", (kind == "categorical") & F.col("parse_ok"))
    item = df.groupBy("rid", "model", "prompt", "condition", "item").agg(
        F.sum(F.when(F.col("likert"), F.col("abs_err"))).alias("e"), F.count_if(F.col("likert")).alias("nl"), F.count_if(F.col("likert") & (F.col("abs_err") <= 1)).alias("w"),
        F.count_if(F.col("nominal")).alias("nc"), F.count_if(F.col("nominal") & (F.col("abs_err") == 0)).alias("m"), F.count_if(~F.col("parse_ok")).alias("f"), F.count("*").alias("n"),
        F.max(F.when(F.col("sample") == 1, F.col("pred_code"))).alias("s1"), F.max(F.when(F.col("sample") == 2, F.col("pred_code"))).alias("s2"),
    )
    t = lambda c: F.sum(c).cast("double")
    return item.groupBy("rid", "model", "prompt", "condition").agg(
        F.round(t("e") / t("nl"), 3).alias("likert_mae"), F.round(100 * t("w") / t("nl"), 1).alias("within1"), F.round(100 * t("m") / F.when(t("nc") > 0, t("nc")), 1).alias("cat_match"),
        F.round(100 * t("f") / t("n"), 1).alias("parse_failure"), F.round(100 * F.avg((F.col("s1") == F.col("s2")).cast("double")), 1).alias("self_consistency"),
    )


def condition_three_ways(df: DataFrame) -> DataFrame:
    """Respondent-macro, item-macro and pooled conservative error by condition."""
    cell = df.groupBy("condition", "rid", "item").agg(F.sum("err").alias("s"), F.count("err").alias("n"))
    macro = cell.groupBy("condition", "rid").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy("condition").agg(r6(F.avg("m")).alias("respondent_macro"), F.count("*").alias("n_respondents"))
    items = cell.groupBy("condition", "item").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    rest = items.groupBy("condition").agg(r6(F.avg(F.col("s") / F.col("n"))).alias("item_macro"), r6(F.sum("s") / F.sum("n")).alias("pooled"))
    return macro.join(rest, "condition")


def cell_variance(df: DataFrame) -> DataFrame:
    """Population variance over respondents of their mean code, by model, prompt and item."""
    mean = df.where("parse_ok").groupBy("model", "prompt", "item", "rid").agg(F.avg(F.col("pred_code").cast("double")).alias("m"))
    return mean.groupBy("model", "prompt", "item").agg(r6(F.var_pop("m")).alias("variance"), F.count("*").alias("n"))


def human_variance(truth: DataFrame) -> DataFrame:
    v = F.var_pop(F.col("true_code").cast("double"))
    return truth.groupBy("item").agg(F.count("*").alias("n"), r6(v).alias("human_variance"), r6(v * 0.3).alias("threshold"))


def variance_gate(cells: DataFrame, human: DataFrame, floor: float = 0.30, most: float = 0.30) -> DataFrame:
    """DQ-3: the share of items whose variance ratio is under the floor; items without a reference abstain."""
    ratio = cells.join(F.broadcast(human.where("human_variance > 0").select("item", "human_variance")), "item").withColumn("low", F.col("variance") / F.col("human_variance") < floor)
    share = F.avg(F.col("low").cast("double"))
    return ratio.groupBy("model", "prompt").agg(F.count("*").alias("n_items"), F.count_if(F.col("low")).alias("n_low"), r6(share).alias("share_low"), (share <= most).alias("passes"))


def majority(truth: DataFrame) -> DataFrame:
    """The modal true code of each item (smallest code on ties), its share and count."""
    one = truth.groupBy("item", "rid").agg(F.min("true_code").alias("true_code"))
    counts = one.groupBy("item", "true_code").agg(F.count("*").alias("n"))
    return counts.groupBy("item").agg(F.min_by("true_code", F.struct(-F.col("n"), F.col("true_code"))).alias("mode"), F.max("n").alias("n_mode"), F.sum("n").alias("n"), r6(F.max("n") / F.sum("n")).alias("share"))


def majority_baseline(truth: DataFrame) -> DataFrame:
    """Error of always answering the mode: respondent-macro and item-macro."""
    rows = truth.join(F.broadcast(majority(truth).select("item", "mode")), "item")
    nominal = (F.col("fmt") == "binary") | ((F.col("fmt") == "contingent") & ((F.col("true_code") == 7) | (F.col("mode") == 7)))
    err = F.when(nominal, (F.col("mode") != F.col("true_code")).cast("double")).otherwise(F.abs(F.col("mode") - F.col("true_code")).cast("double")) / (F.col("hi") - F.col("lo"))
    rows = rows.withColumn("err", err)
    macro = rows.groupBy("rid").agg(F.avg("err").alias("m")).agg(r6(F.avg("m")).alias("respondent_macro"), F.count("*").alias("n"))
    return macro.join(rows.groupBy("item").agg(F.avg("err").alias("m")).agg(r6(F.avg("m")).alias("item_macro")))


def item_profile(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts, exact match on parsed rows, parse rate, distinct codes, top-1 share by slice and item."""
    hist = df.groupBy(*by, "item", "pred_code").agg(F.count("*").alias("n"), F.count_if("parse_ok").alias("ok"), F.sum("exact0").alias("hit"), F.sum("err").alias("err"))
    ok = F.sum("ok")
    return hist.groupBy(*by, "item").agg(
        F.sum("n").alias("n_total"), ok.alias("n_ok"), (F.sum("n") - ok).alias("n_pf"), F.sum("hit").cast("long").alias("n_exact"), r6(F.sum("hit") / ok).alias("em"), r6(ok / F.sum("n")).alias("parse_rate"),
        r6(F.sum("err") / F.sum("n")).alias("err"), F.count_if(F.col("ok") > 0).alias("distinct_codes"), r6(F.max("ok") / ok).alias("top1_share"),
    )


def collapse(df: DataFrame) -> DataFrame:
    """Collapsed answers: top-1 share above 0.95 (one distinct code for two-option items)."""
    k = df.groupBy("item").agg((F.max("hi") - F.max("lo") + 1).alias("k"))
    prof = item_profile(df, ["model"]).join(F.broadcast(k), "item")
    return prof.select("model", "item", "distinct_codes", "top1_share", F.when(F.col("k") >= 3, F.col("top1_share") > 0.95).otherwise(F.col("distinct_codes") == 1).alias("collapsed"))


def _levels(df: DataFrame) -> DataFrame:
    """(rid, factor, level, err, exact, n): a respondent's mean over cells and items, samples first, for every model and prompt."""
    cell = df.groupBy("rid", "item", "model", "prompt").agg(F.avg("err").alias("e"), F.avg("exact0").alias("x"), F.count("*").alias("n"))
    both = F.explode(F.array(F.struct(F.lit("model").alias("factor"), F.col("model").alias("level")), F.struct(F.lit("prompt").alias("factor"), F.col("prompt").alias("level"))))
    return cell.select("rid", both.alias("f"), "e", "x", "n").groupBy("rid", "f.factor", "f.level").agg(F.avg("e").alias("err"), F.avg("x").alias("exact"), F.sum("n").alias("n"))


def main_effects(df: DataFrame) -> DataFrame:
    """Respondent-macro error and exact match by model (over prompts) and by prompt (over models)."""
    return _levels(df).groupBy("factor", "level").agg(r6(F.avg("err")).alias("err"), r6(F.avg("exact")).alias("exact"), F.sum("n").alias("n"), F.count("*").alias("n_respondents"))


def main_effect_intervals(df: DataFrame, B: int = 1000) -> DataFrame:
    """`main_effects` with percentile intervals of the error, respondents resampled."""
    ci = ST.ratio_intervals(_levels(df).withColumn("one", F.lit(1.0)), ["factor", "level"], "err", "one", B=B, method="percentile")
    return main_effects(df).join(ci.select("factor", "level", "lo", "hi"), ["factor", "level"])


def _difficulty(df: DataFrame) -> DataFrame:
    """(item, rid, err, exact): a respondent's mean over the cells that asked the item, samples first."""
    cell = df.groupBy("item", "rid", "model", "prompt").agg(F.avg("err").alias("e"), F.avg("exact0").alias("x"), F.count("*").alias("n"))
    return cell.groupBy("item", "rid").agg(F.avg("e").alias("err"), F.avg("x").alias("exact"), F.sum("n").alias("n"))


def item_difficulty(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Per item over all cells: respondent-macro error and exact match beside the modal answer's and a uniform guess's, and the lift over the modal answer."""
    options = df.groupBy("item").agg((F.max("hi") - F.min("lo") + 1).alias("k"))
    base = majority(truth).select("item", (F.col("n_mode") / F.col("n")).alias("base"), F.col("n").alias("n_truth"))
    rows = _difficulty(df).groupBy("item").agg(F.avg("err").alias("e"), F.avg("exact").alias("x"), F.sum("n").alias("n"), F.count("*").alias("n_respondents")).join(options, "item").join(base, "item", "left")
    return rows.select("item", "k", r6("e").alias("err"), r6("x").alias("exact"), r6("base").alias("maj_em"), r6(1 / F.col("k")).alias("uniform_em"), r6(S.lift(F.col("x"), F.col("base"))).alias("lift_maj"), "n", "n_respondents", "n_truth")


def item_difficulty_intervals(df: DataFrame, truth: DataFrame, B: int = 1000) -> DataFrame:
    """`item_difficulty` with percentile intervals of the error, respondents resampled."""
    ci = ST.ratio_intervals(_difficulty(df).withColumn("one", F.lit(1.0)), ["item"], "err", "one", B=B, method="percentile")
    return item_difficulty(df, truth).join(ci.select("item", "lo", "hi"), "item")


def _panels(df: DataFrame, models: list[str], *more: str, facts: tuple[str, ...] = ()) -> DataFrame:
    """One row for each answer of a whole panel with a column for each model's code, by plain hash aggregation: (keys.., ok, facts.., m0, m1, ..)."""
    code = lambda m: F.max(F.when(F.col("model") == m, F.col("pred_code")))
    seen = F.bit_or(F.element_at(F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(1 << i))]), F.col("model")))
    rows = df.where(F.col("model").isin(*models)).groupBy("rid", "prompt", "condition", "item", "sample", *more)
    return rows.agg(seen.alias("_seen"), F.bool_and("parse_ok").alias("ok"), *[F.max(c).alias(c) for c in facts], *[code(m).alias(f"m{i}") for i, m in enumerate(models)]).where(F.col("_seen") == (1 << len(models)) - 1).drop("_seen")


def agreement(df: DataFrame, models: list[str]) -> DataFrame:
    """Strict agreement %: all expected models present, parsed and identical; failures stay in the denominator."""
    codes = [F.col(f"m{i}") for i in range(len(models))]
    same = F.col("ok") & (F.least(*codes) == F.greatest(*codes)) if len(codes) > 1 else F.col("ok")
    return _panels(df, models).groupBy("prompt", "condition").agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), r6(100 * F.avg(F.coalesce(same, F.lit(False)).cast("double"))).alias("agreement"))


def panel_code(df: DataFrame, models: list[str], valid: Column | None = None, facts: tuple[str, ...] = ()) -> DataFrame:
    """The panel's answer: the median of ordinal items, snapped to the nearest valid code; the mode of binary and categorical ones, and
    of contingent ones where a model gave 7.

    `valid` is the array of valid codes (lo to hi without one).  Ties are broken by a hash of item, respondent, sorted codes and
    sorted candidates.  Tuples with a parse failure become failures (null); incomplete panels are dropped.
    `facts` are columns that all rows of an answer share, and are carried along.
    """
    rows = _panels(df, models, "lo", "hi", "fmt", facts=facts).withColumn("codes", F.array_sort(F.array(*[F.col(f"m{i}") for i in range(len(models))])))
    codes = F.col("codes")
    k = len(models)
    given = [F.col(f"m{i}") for i in range(k)]
    rows = rows.withColumn("_votes", F.array(*[sum((F.coalesce(c == x, F.lit(False)).cast("int") for x in given), F.lit(0)) for c in given])).withColumn("_most", F.array_max("_votes"))
    modes = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.get("_votes", F.lit(i)) == F.col("_most"), c) for i, c in enumerate(given)]))))
    twice = F.element_at(codes, (k + 1) // 2) + F.element_at(codes, k // 2 + 1)
    rows = rows.withColumn("_twice", twice)
    away = lambda c: F.abs(2 * c - F.col("_twice"))
    choices = F.array_sort(valid) if valid is not None else F.sequence("lo", "hi")
    rows = rows.withColumn("_valid", choices).withColumn("_near", F.array_min(F.transform("_valid", away)))
    middle = F.filter("_valid", lambda c: away(c) == F.col("_near"))
    nominal = F.col("fmt").isin("binary", "categorical") | ((F.col("fmt") == "contingent") & F.array_contains(codes, F.lit(7).cast("long")))
    rows = rows.withColumn("options", F.when(F.col("ok"), F.when(nominal, modes).otherwise(middle)))
    text = lambda x: F.array_join(x.cast("array<string>"), ",")
    pick = S.hash_pick(F.concat_ws("|", "item", F.col("rid").cast("string"), text(codes), text(F.col("options"))), F.size("options"), 8)
    code = F.when(F.size("options") <= 1, F.get("options", F.lit(0))).otherwise(F.element_at("options", (pick + 1).cast("int")))
    return rows.select("rid", "prompt", "condition", "item", "sample", "ok", F.when(F.col("ok"), code).alias("panel_code"), *(("lo", "hi", "fmt", *facts) if facts else ()))


def no_profile(df: DataFrame) -> DataFrame:
    """Per item: base rate, mode match and expected exact match of truth and prediction histograms."""
    h = df.select("item", F.explode(F.array(F.struct(F.col("true_code").alias("code"), F.lit("t").alias("side")), F.struct(F.col("pred_code").alias("code"), F.lit("p").alias("side")))).alias("x"))
    h = h.where("x.code is not null").groupBy("item", "x").agg(F.count("*").alias("n")).groupBy("item", F.col("x.code").alias("code")).agg(F.sum(F.when(F.col("x.side") == "t", F.col("n"))).alias("t"), F.sum(F.when(F.col("x.side") == "p", F.col("n"))).alias("p"))
    t, p = F.coalesce("t", F.lit(0)), F.coalesce("p", F.lit(0))
    out = h.groupBy("item").agg((F.max(t) / F.sum(t)).alias("base"), (F.sum(t * p) / (F.sum(t) * F.sum(p))).alias("expected"), F.max_by(t, F.struct(p, -F.col("code"))).alias("hit"), F.sum(t).alias("n"))
    return out.select("item", r6("base").alias("base_rate"), r6(F.col("hit") / F.col("n")).alias("mode_match"), r6("expected").alias("expected_match"), r6(S.lift(F.col("expected"), F.col("base"))).alias("lift"))


def router(df: DataFrame, parts: DataFrame, value: str = "err") -> DataFrame:
    """Learn the best model per item on train, score on test against the best single model and the per-item oracle.

    `parts` has one row for each respondent: hashed by rid, never sent whole to the driver.
    """
    rows = df.join(parts.hint("shuffle_hash"), "rid").groupBy("item", "model").agg(F.sum(F.when(F.col("part") == "train", F.col(value))).alias("a"), F.count(F.when(F.col("part") == "train", 1)).alias("na"), F.sum(F.when(F.col("part") == "test", F.col(value))).alias("b"), F.count(F.when(F.col("part") == "test", 1)).alias("nb"))
    single = rows.groupBy("model").agg((F.sum("a") / F.sum("na")).alias("m"), (F.sum("b") / F.sum("nb")).alias("single")).agg(F.min_by("single", F.struct("m", "model")).alias("single"), F.min_by("model", F.struct("m", "model")).alias("best_single"))
    best = rows.groupBy("item").agg(F.min_by(F.struct("b", "nb"), F.struct(F.col("a") / F.col("na"), F.col("model"))).alias("r"), F.min_by(F.struct("b", "nb"), F.struct(F.col("b") / F.col("nb"), F.col("model"))).alias("o"))
    routed = best.agg((F.sum("r.b") / F.sum("r.nb")).alias("routed"), (F.sum("o.b") / F.sum("o.nb")).alias("oracle"))
    return routed.join(single).select("best_single", r6("routed").alias("routed"), r6("single").alias("single"), r6("oracle").alias("oracle"), r6(F.col("single") - F.col("routed")).alias("gain"))


def holm(df: DataFrame, family: list[str], p: str = "p", key: str = "key", alpha: float = 0.05) -> DataFrame:
    """Holm step-down inside each family: p_adj and significant (stops at the first failure)."""
    order = Window.partitionBy(*family).orderBy(p, key)
    rank, m = F.row_number().over(order), F.count("*").over(Window.partitionBy(*family))
    raw = F.least(F.lit(1.0), F.col(p) * (m - rank + 1))
    df = df.withColumn("_raw", raw)
    return df.withColumn("p_adj", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("significant", F.col("p_adj") <= alpha).drop("_raw")


def run_health(events: DataFrame) -> DataFrame:
    """Call outcomes by model: ok, parse failures, provider errors, % bad."""
    kind = S.error_type(F.col("event_type") != "signup", F.col("event_type") == "error")
    df = events.select((F.col("event_id") % 4).alias("model_no"), kind.alias("kind"))
    n = F.count("*")
    return df.groupBy("model_no").agg(n.alias("n"), F.count_if(F.col("kind") == "ok").alias("ok"), F.count_if(F.col("kind") == "parse_fail").alias("parse_fail"), F.count_if(F.col("kind") == "provider_error").alias("provider_error"), r6(100 * F.count_if(F.col("kind") != "ok") / n).alias("bad_percent"))
