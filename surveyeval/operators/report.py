"""Report tables composed of the aggregations: headline, cell roll-up, side-by-side models, coverage, single-model rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T

r6 = T.r6


def headline(df: DataFrame) -> DataFrame:
    """Respondent-macro, item-macro and pooled error by condition, with the mean paired delta to Full."""
    delta = T.pair_conditions(df).groupBy("condition").agg(r6(F.avg("delta")).alias("delta"), F.count("*").alias("n_pairs"))
    return T.condition_three_ways(df).join(delta, "condition", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0).cast("long")))


def cell_rollup(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Per cell: means over items, the collapsed items (by name) and how many items beat the majority answer."""
    k = df.groupBy("item").agg((F.max("hi") - F.max("lo") + 1).alias("k"))
    rows = T.item_profile(df, ["model", "prompt"]).join(F.broadcast(k), "item").join(F.broadcast(T.majority(truth).select("item", "share")), "item")
    collapsed = F.when(F.col("k") >= 3, F.col("top1_share") > 0.95).otherwise(F.col("distinct_codes") == 1)
    return rows.groupBy("model", "prompt").agg(
        r6(F.avg("em")).alias("em"), r6(F.avg("err")).alias("err"), r6(F.avg("parse_rate")).alias("parse_rate"), F.count_if(collapsed).alias("n_collapsed"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(collapsed, F.col("item"))))).alias("collapsed_items"), F.count_if(F.col("em") > F.col("share")).alias("n_positive_lift"),
    )


def dissection(df: DataFrame, one: str, other: str) -> DataFrame:
    """Two models side by side per item: exact match, error and top-1 share."""
    rows = T.item_profile(df.where(F.col("model").isin(one, other)), ["model"])
    side = lambda m, c, n: F.max(F.when(F.col("model") == m, F.col(c))).alias(n)
    return rows.groupBy("item").agg(*[side(m, c, f"{c}_{s}") for m, s in ((one, "a"), (other, "b")) for c in ("em", "err", "top1_share")])


def item_flip(df: DataFrame) -> DataFrame:
    """Levels, exact match and error of each item."""
    return df.groupBy("item", "lo", "hi").agg(r6(F.avg("exact0")).alias("exact"), r6(F.avg("err")).alias("err")).select("item", (F.col("hi") - F.col("lo") + 1).alias("levels"), "exact", "err")


def anchor_compare(df: DataFrame, truth: DataFrame, anchor: str) -> DataFrame:
    """Per item the anchor model beside the other models, with the majority share of the truths."""
    is_anchor = F.col("model") == anchor
    side = lambda c, cond: r6(F.avg(F.when(cond, F.col(c))))
    rows = df.groupBy("item").agg(side("exact0", ~is_anchor).alias("em_panel"), side("exact0", is_anchor).alias("em_anchor"), side("err", ~is_anchor).alias("err_panel"), side("err", is_anchor).alias("err_anchor"))
    return rows.join(F.broadcast(T.majority(truth).select("item", F.col("share").alias("em_majority"))), "item")


def rule_cost(df: DataFrame) -> DataFrame:
    """What the ablated arm costs per item: mean paired error difference and pairs."""
    return T.pair_ablation(df).groupBy("item").agg(r6(F.avg(F.col("other") - F.col("base"))).alias("delta"), F.count("*").alias("n_pairs"))


def coverage(truth: DataFrame, people: DataFrame) -> DataFrame:
    """Respondents who answered each item, in number and in percent of all."""
    total = people.agg(F.count("*").alias("total"))
    n = truth.groupBy("item").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(total)).select("item", "n", r6(100 * F.col("n") / F.col("total")).alias("percent"))


def single_model(df: DataFrame, parts: DataFrame, rates: DataFrame, window: float = 1.05) -> DataFrame:
    """The cheapest model whose likert macro error on train is within the window of the best, with its error on test."""
    rows = df.where(F.col("parse_ok") & F.col("fmt").startswith("likert")).join(parts.hint("shuffle_hash"), "rid")
    macro = rows.groupBy("model", "part", "rid").agg(F.avg(F.col("abs_err").cast("double")).alias("m")).groupBy("model").agg(r6(F.avg(F.when(F.col("part") == "train", F.col("m")))).alias("train"), r6(F.avg(F.when(F.col("part") == "test", F.col("m")))).alias("validation"))
    macro = macro.join(F.broadcast(rates), "model", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))
    near = macro.withColumn("best", F.min("train").over(Window.partitionBy())).where(F.col("train") <= F.col("best") * window)
    return near.orderBy("rate", "train", "model").limit(1).select("model", "train", "validation")
