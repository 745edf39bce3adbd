"""Cell tables, re-scoring under item filters, traits, panel headlines and checks of the item and battery tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import stats as ST
from . import tables as T

r6 = T.r6


def marginal_means(df: DataFrame) -> DataFrame:
    """Exact match on both bases and error by model and by prompt, in one pass."""
    sets = df.groupingSets([[F.col("model")], [F.col("prompt")]], "model", "prompt")
    rows = sets.agg(r6(F.avg("exact")).alias("em_parsed"), r6(F.avg("exact0")).alias("em_all"), r6(F.avg("err_opt")).alias("err_parsed"), r6(F.avg("err")).alias("err_all"))
    return rows.select(F.when(F.col("model").isNotNull(), "model").otherwise("prompt").alias("factor"), F.coalesce("model", "prompt").alias("level"), "em_parsed", "em_all", "err_parsed", "err_all")


def databook(df: DataFrame, truth: DataFrame, rates: dict[str, float]) -> DataFrame:
    """One row per model, prompt and item with baselines, lifts, diversity and cost, and analytic rows of a uniform guess (model Uniform)."""
    hist = df.groupBy("model", "prompt", "item", "lo", "hi", "pred_code").agg(
        F.count("*").alias("n"), F.count_if("parse_ok").alias("ok"), F.sum("exact0").alias("hit"), F.sum("abs_err").cast("double").alias("raw"), F.sum("err").alias("err"), F.count_if(F.col("parse_ok") & (F.col("abs_err") <= 1)).alias("w1"),
    )
    n, ok = F.sum("n"), F.sum("ok")
    cells = hist.groupBy("model", "prompt", "item", "lo", "hi").agg(
        (F.sum("hit") / ok).alias("em"), (F.sum("raw") / ok).alias("mae_raw"), (F.sum("err") / n).alias("mae_normalized"), (F.sum("w1") / ok).alias("w1"), ok.alias("n_eff"), (1 - ok / n).alias("parse_fail_rate"),
        F.count_if(F.col("ok") > 0).alias("pred_distinct_codes"), (F.max("ok") / ok).alias("pred_top1_share"),
    )
    guess = truth.groupBy("item", "lo", "hi").agg(F.avg(F.aggregate(F.sequence("lo", "hi"), F.lit(0.0), lambda a, c: a + F.abs(c - F.col("true_code")))).alias("total"))
    k = F.col("hi") - F.col("lo") + 1
    none = F.lit(None)
    uniform = guess.select(F.lit("Uniform").alias("model"), F.lit("-").alias("prompt"), "item", "lo", "hi", (1.0 / k).alias("em"), (F.col("total") / k).alias("mae_raw"), (F.col("total") / k / (k - 1)).alias("mae_normalized"), none.cast("double").alias("w1"), none.cast("long").alias("n_eff"), F.lit(0.0).alias("parse_fail_rate"), k.alias("pred_distinct_codes"), (1.0 / k).alias("pred_top1_share"))
    rows = cells.unionByName(uniform).join(F.broadcast(T.majority(truth).select("item", F.col("share").alias("maj_em"))), "item")
    cost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for m, r in rates.items() for x in (m, r)]), F.col("model")), F.lit(0.0))
    rnd = 1.0 / k
    shown = [r6(c).alias(c) for c in ("em", "mae_raw", "mae_normalized", "w1")] + ["n_eff"] + [r6(c).alias(c) for c in ("parse_fail_rate", "maj_em")]
    return rows.select("model", "prompt", "item", k.alias("k"), *shown, r6(rnd).alias("rnd_em"), r6(S.lift(F.col("em"), rnd)).alias("lift_rnd"), r6(S.lift(F.col("em"), F.col("maj_em"))).alias("lift_maj"), "pred_distinct_codes", r6("pred_top1_share").alias("pred_top1_share"), cost.alias("cost_per_call"))


def multimodel_rows(df: DataFrame, models: list[str]) -> DataFrame:
    """(rid, prompt, item, model, err): the answers of every model, and the panel's under the name panel."""
    answers = T.panel_code(df, models, facts=("true_code",))
    ok = F.col("ok")
    nominal = (F.col("fmt") == "binary") | ((F.col("fmt") == "contingent") & ((F.col("true_code") == 7) | (F.col("panel_code") == 7)))
    raw = F.when(nominal, (F.col("panel_code") != F.col("true_code")).cast("double")).otherwise(F.abs(F.col("panel_code") - F.col("true_code")).cast("double"))
    panel = answers.select("rid", "prompt", "item", F.lit("panel").alias("model"), F.when(ok, raw / (F.col("hi") - F.col("lo"))).otherwise(1.0).alias("err"))
    return df.where(F.col("model").isin(*models)).select("rid", "prompt", "item", "model", "err").unionByName(panel)


def multimodel_headline(df: DataFrame, models: list[str]) -> DataFrame:
    """Error three ways for every model and for the panel's answer, and the agreement of the models, by prompt."""
    rows = multimodel_rows(df, models)
    cell = rows.groupBy("model", "prompt", "rid", "item").agg(F.sum("err").alias("s"), F.count("err").alias("n"))
    macro = cell.groupBy("model", "prompt", "rid").agg((F.sum("s") / F.sum("n")).alias("m")).groupBy("model", "prompt").agg(r6(F.avg("m")).alias("respondent_macro"))
    items = cell.groupBy("model", "prompt", "item").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).groupBy("model", "prompt").agg(r6(F.avg(F.col("s") / F.col("n"))).alias("item_macro"), r6(F.sum("s") / F.sum("n")).alias("pooled"), F.sum("n").alias("n"))
    return macro.join(items, ["model", "prompt"]).join(F.broadcast(T.agreement(df, models).select("prompt", "agreement")), "prompt", "left")


def unknown_codes(answers: DataFrame, variables: list[str]) -> DataFrame:
    """Negative codes that no missing-value list names, per variable with their counts."""
    long = answers.unpivot(["rid"], variables, "var", "code").where(F.col("code") < 0)
    return long.where(~S.is_missing(F.col("code"))).groupBy("var", "code").agg(F.count("*").alias("n"))


def taxonomy_checks(features: DataFrame, predictions: DataFrame, batteries: DataFrame, bins: list[str], items: list[str]) -> DataFrame:
    """(check, name, n): features per bin, features of unknown bins, features that are targets, dropped batteries that the map lacks."""
    known = F.col("bin").isin(*bins)
    per_bin = features.groupBy("bin").agg(F.count("*").alias("n")).select(F.when(known, "bin_size").otherwise("unknown_bin").alias("check"), F.col("bin").alias("name"), "n")
    target = features.where(F.col("var").isin(*items)).groupBy(F.col("var").alias("name")).agg(F.count("*").alias("n")).select(F.lit("target_is_feature").alias("check"), "name", "n")
    used = predictions.where("battery_no is not null").groupBy("battery_no").agg(F.count("*").alias("n"))
    joined = used.join(F.broadcast(batteries), "battery_no", "full")
    battery = joined.select(F.when(F.col("battery").isNull(), "unknown_battery").when(F.col("n").isNull(), "unused_battery").otherwise("battery_size").alias("check"), F.coalesce("battery", F.col("battery_no").cast("string")).alias("name"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return per_bin.unionByName(target).unionByName(battery)


def leak_rescore(df: DataFrame, strong: list[str], soft: list[str]) -> DataFrame:
    """Each respondent and condition under three item filters: all, without strongly and without strongly or softly leaking items."""
    is_strong, is_soft = F.col("item").isin(*strong), F.col("item").isin(*soft)
    filters = F.array_compact(F.array(F.lit("all"), F.when(~is_strong, F.lit("minus_strong")), F.when(~is_strong & ~is_soft, F.lit("minus_both"))))
    kind = S.treatment(F.col("fmt"), F.col("true_code"), F.col("pred_code"))
    rows = df.where("parse_ok").select("rid", "condition", "abs_err", (kind == "likert").alias("likert"), F.explode(filters).alias("filter"))
    mean = lambda c, x: r6(100 * F.avg(F.when(c, x.cast("double"))))
    likert, e = F.col("likert"), F.col("abs_err")
    return rows.groupBy("rid", "condition", "filter").agg(F.count("*").alias("n"), r6(F.avg(F.when(likert, e.cast("double")))).alias("mae"), mean(likert, e <= 1).alias("within1"), mean(~likert, e == 0).alias("cat_match"))


def trait_rmse(df: DataFrame, traits: dict[str, list[tuple[str, bool]]]) -> DataFrame:
    """Root mean squared difference of true and predicted trait scores per respondent and condition, over the traits both have.

    A trait is the mean of its items on a 0-1 scale; reversed items count from the top.
    """
    parts = [F.when(F.col("item") == i, F.struct(F.lit(t).alias("trait"), F.lit(rev).alias("rev"))) for t, members in traits.items() for i, rev in members]
    span = F.col("hi") - F.col("lo")
    unit = lambda c: F.when(F.col("x.rev"), (F.col("hi") - F.col(c)) / span).otherwise((F.col(c) - F.col("lo")) / span)
    rows = df.where("parse_ok").withColumn("x", F.coalesce(*parts)).where("x is not null")
    score = rows.groupBy("rid", "condition", F.col("x.trait").alias("trait")).agg(F.avg(unit("true_code")).alias("t"), F.avg(unit("pred_code")).alias("p"))
    d = F.col("t") - F.col("p")
    return score.groupBy("rid", "condition").agg(F.count("*").alias("n_traits"), r6(F.sqrt(F.avg(d * d))).alias("rmse"))


def rank_match(subsets: DataFrame, players: int = 4) -> DataFrame:
    """Leave-one-out and Shapley values of every player with their ranks, and whether all ranks agree."""
    full = 2**players - 1
    loo = [F.max(F.when(F.col("mask") == full - 2**p, F.col("value"))) - F.max(F.when(F.col("mask") == full, F.col("value"))) for p in range(players)]
    table = subsets.agg(F.array(*[F.struct(F.lit(p).alias("player"), r6(v).alias("loo")) for p, v in enumerate(loo)]).alias("x")).select(F.inline("x"))
    both = table.join(ST.shapley(subsets, players), "player")
    ranked = both.withColumn("loo_rank", F.row_number().over(Window.orderBy(F.desc("loo"), "player")).cast("long")).withColumn("shapley_rank", F.row_number().over(Window.orderBy(F.desc("shapley"), "player")).cast("long"))
    return ranked.withColumn("all_match", F.bool_and(F.col("loo_rank") == F.col("shapley_rank")).over(Window.partitionBy()))


def answered_per_bin(features: DataFrame, people: DataFrame, bins: list[str]) -> DataFrame:
    """Per bin: the median number of answered features over all respondents, and how many have at least one; respondents without any count as 0."""
    counts = features.groupBy("rid").agg(*[F.count_if(F.col("bin") == b).alias(b) for b in bins])
    long = people.select("rid").join(counts, "rid", "left").na.fill(0, bins).unpivot(["rid"], bins, "bin", "n")
    return long.groupBy("bin").agg(F.percentile("n", F.lit(0.5)).alias("median_answered"), F.count_if(F.col("n") >= 1).alias("n_any"), F.count("*").alias("n_respondents"))
