"""Comparisons of arms, cells and policies over the scored long table, with their intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rescore as RC
from . import stats as ST
from . import tables as T

r6 = T.r6


def common_respondents(df: DataFrame, conditions: list[str], value: str = "err") -> DataFrame:
    """(rid) of respondents with a value in every one of the conditions; any number of conditions, one aggregation by respondent."""
    wanted = sorted(set(conditions))
    if not wanted:
        raise ValueError("no conditions")
    return df.where(F.col("condition").isin(*wanted) & F.col(value).isNotNull()).groupBy("rid").agg(F.countDistinct("condition").alias("k")).where(F.col("k") == len(wanted)).select("rid")


def item_profile_with_variance(df: DataFrame, by: list[str], human: DataFrame) -> DataFrame:
    """`tables.item_profile` plus var_ratio: the variance over respondents of their mean code beside that of the true codes.

    Fewer than two respondents vary by 0; an item without a positive reference variance has no ratio.
    """
    mean = df.where("parse_ok").groupBy(*by, "item", "rid").agg(F.avg(F.col("pred_code").cast("double")).alias("m"))
    own = mean.groupBy(*by, "item").agg(F.coalesce(F.var_pop("m"), F.lit(0.0)).alias("v"))
    ref = human.select("item", F.when(F.col("human_variance") > 0, F.col("human_variance")).alias("h"))
    out = T.item_profile(df, by).join(own, [*by, "item"], "left").join(ref, "item", "left")
    return out.withColumn("var_ratio", r6(F.coalesce("v", F.lit(0.0)) / F.col("h"))).drop("v", "h")


def cell_errors(df: DataFrame, by: list[str]) -> DataFrame:
    """Respondent-macro error of each cell under both policies: failures count as misses (macro, n), or are left out (optimistic, n_optimistic)."""
    means = df.groupBy("rid", *by).agg(F.avg("err").alias("a"), F.avg("err_opt").alias("b"))
    return means.groupBy(*by).agg(r6(F.avg("a")).alias("macro"), F.count("a").alias("n"), r6(F.avg("b")).alias("optimistic"), F.count("b").alias("n_optimistic"))


def arms_by_item(rows: DataFrame, arms: list[str]) -> DataFrame:
    """Per item and arm (column `arm`): exact match on parsed answers, and the error (of an arm of several models the mean of their means), one row an item.

    Columns are em_<arm>, err_<arm> and n_<arm> (parsed answers) of the arms listed.
    """
    model = rows.groupBy("item", "arm", "model").agg(F.sum(F.when(F.col("parse_ok"), F.col("exact0"))).alias("hit"), F.count_if("parse_ok").alias("ok"), F.avg("err").alias("e"))
    cell = model.groupBy("item", "arm").agg((F.sum("hit") / F.when(F.sum("ok") > 0, F.sum("ok"))).alias("em"), F.avg("e").alias("err"), F.sum("ok").alias("n"))
    side = lambda a, c: F.max(F.when(F.col("arm") == a, F.col(c)))
    return cell.groupBy("item").agg(*[x for a in arms for x in (r6(side(a, "em")).alias(f"em_{a}"), r6(side(a, "err")).alias(f"err_{a}"), F.coalesce(side(a, "n"), F.lit(0)).alias(f"n_{a}"))])


def pooled_arms(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """(arm, em, n): exact match pooled over all parsed answers of an arm, and as arm "majority" that of always giving an item's modal truth."""
    own = rows.groupBy("arm").agg(r6(F.sum(F.when(F.col("parse_ok"), F.col("exact0"))) / F.when(F.count_if("parse_ok") > 0, F.count_if("parse_ok"))).alias("em"), F.count_if("parse_ok").alias("n"))
    mode = T.majority(truth).agg(r6(F.sum("n_mode") / F.sum("n")).alias("em"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("majority").alias("arm"), "em", "n")
    return own.unionByName(mode)


def arm_summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and count of every metric by arm, and the rows of the arm; values that are no numbers are skipped."""
    held = rows.select(*by, *[F.col(m).try_cast("double").alias(m) for m in metrics])
    number = lambda m: F.when(~F.isnan(m), F.col(m))
    return held.groupBy(*by).agg(F.count("*").alias("n_respondents"), *[x for m in metrics for x in (r6(F.avg(number(m))).alias(f"{m}_mean"), r6(F.stddev_samp(number(m))).alias(f"{m}_sd"), F.count(number(m)).alias(f"{m}_n"))])


def battery_items(df: DataFrame, batteries: DataFrame) -> DataFrame:
    """(battery, bin, item, delta, n_pairs, share): a battery's paired error delta by item, and the part of the battery's delta that each item brings."""
    pairs = T.pair_ablation(df).groupBy("battery_no", "item").agg(F.sum(F.col("other") - F.col("base")).alias("s"), F.count("*").alias("n_pairs"))
    whole = pairs.groupBy("battery_no").agg(F.sum("n_pairs").alias("n"))
    rows = pairs.join(whole, "battery_no").join(batteries.select("battery_no", "battery", "bin"), "battery_no")
    return rows.select("battery", "bin", "item", r6(F.col("s") / F.col("n_pairs")).alias("delta"), "n_pairs", r6(F.col("s") / F.col("n")).alias("share"))


def router(df: DataFrame, parts: DataFrame, value: str = "err", highest: bool = False) -> DataFrame:
    """Learn the best model per item on train and score it on test, beside the best single model and the per-item oracle; `highest` for values that are better when higher.

    Rows (best_single, routed, single, oracle, gain); gain is positive where routing is better.  Ties go to the model of the least name.
    """
    sign = -1 if highest else 1
    at = lambda part, x: F.when(F.col("part") == part, x)
    rows = df.join(parts.hint("shuffle_hash"), "rid").groupBy("item", "model").agg(F.sum(at("train", F.col(value))).alias("a"), F.count(at("train", F.col(value))).alias("na"), F.sum(at("test", F.col(value))).alias("b"), F.count(at("test", F.col(value))).alias("nb"))
    rank = lambda s, n: F.struct((sign * F.col(s) / F.col(n)).alias("m"), "model")
    both = F.struct("b", "nb")
    best = rows.groupBy("item").agg(F.min_by(both, rank("a", "na")).alias("r"), F.min_by(both, rank("b", "nb")).alias("o"))
    routed = best.agg((F.sum("r.b") / F.sum("r.nb")).alias("routed"), (F.sum("o.b") / F.sum("o.nb")).alias("oracle"))
    single = rows.groupBy("model").agg((sign * F.sum("a") / F.sum("na")).alias("m"), (F.sum("b") / F.sum("nb")).alias("x")).agg(F.min_by(F.struct("model", "x"), F.struct("m", "model")).alias("s"))
    gain = sign * (F.col("s.x") - F.col("routed"))
    return routed.join(single).select(F.col("s.model").alias("best_single"), r6("routed").alias("routed"), r6("s.x").alias("single"), r6("oracle").alias("oracle"), r6(gain).alias("gain"))


def databook_intervals(df: DataFrame, B: int = 1000) -> DataFrame:
    """Per model, prompt and item percentile intervals, respondents resampled, of exact match (failures as misses) and of the normalized error."""
    by = ["model", "prompt", "item"]
    means = df.groupBy("rid", *by).agg(F.avg("exact0").alias("x"), F.avg("err").alias("e")).withColumn("one", F.lit(1.0))
    long = means.select("rid", *by, "one", F.explode(F.create_map(F.lit("em"), "x", F.lit("mae_norm"), "e")).alias("metric", "v"))
    ci = ST.ratio_intervals(long, [*by, "metric"], "v", "one", B=B, method="percentile")
    side = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return ci.groupBy(*by).agg(*[side(m, c).alias(f"{m}_{n}") for m in ("em", "mae_norm") for c, n in (("point", "mean"), ("lo", "ci_lo"), ("hi", "ci_hi"))], F.max("n").alias("n_respondents"))


def multimodel_intervals(df: DataFrame, models: list[str], B: int = 1000) -> DataFrame:
    """Respondent-macro error of every model and of the panel's answer by prompt, with BCa intervals."""
    rows = RC.multimodel_rows(df, models)
    means = rows.groupBy("rid", "model", "prompt").agg(F.avg("err").alias("m")).where("m is not null").withColumn("one", F.lit(1.0))
    return ST.ratio_intervals(means, ["model", "prompt"], "m", "one", B=B).select("model", "prompt", F.col("point").alias("macro"), "lo", "hi", "n")
