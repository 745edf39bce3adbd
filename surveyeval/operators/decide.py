"""Decision rules over one row per (model, prompt) cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import stats as ST
from . import tables as T


def cells(df: DataFrame, human: DataFrame, most_failures: float = 0.10) -> DataFrame:
    """Error, failure rate, both gates and the rank of surviving cells; the best survivor is `chosen`."""
    rate = df.groupBy("model", "prompt").agg(T.r6(1 - F.avg(F.col("parse_ok").cast("double"))).alias("parse_fail"))
    err = T.respondent_macro(df, ["model", "prompt"])
    gates = T.variance_gate(T.cell_variance(df), human)
    rows = rate.join(err, ["model", "prompt"]).join(gates.select("model", "prompt", "share_low", F.col("passes").alias("variance_ok")), ["model", "prompt"], "left")
    rows = rows.withColumn("survives", (F.col("parse_fail") <= most_failures) & F.coalesce("variance_ok", F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("survives").orderBy("macro", "model", "prompt"))
    rows = rows.withColumn("rank", F.when(F.col("survives"), rank).cast("long"))
    return rows.select("model", "prompt", "parse_fail", "share_low", "macro", "survives", "rank", (F.coalesce("rank", F.lit(0).cast("long")) == 1).alias("chosen"))


def gap_warning(best: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline less best error: warn under 0, note under 0.02."""
    gap = F.round(F.col("baseline") - F.col("best"), 6)
    return best.join(baseline).select("best", "baseline", gap.alias("gap"), F.when(gap < 0, "warn").when(gap < 0.02, "note").otherwise("ok").alias("flag"))


def apply_rule(cells: DataFrame, fallback: tuple[str, str], near: float = 0.01) -> DataFrame:
    """cells (model, prompt, macro, lo, hi, cost_score, survives) plus best, tied, cost_tied, chosen and rationale.

    The best survivor has the least error.  Survivors whose interval overlaps its interval tie with it; of those the cheapest is taken
    if no other costs within `near` of it, else the named fallback.  Without survivors nothing is chosen and the run pauses.
    The windows see one row for each cell.
    """
    every = Window.partitionBy()
    ok = F.col("survives") & F.col("macro").isNotNull()
    first = F.min(F.when(ok, F.struct("macro", "model", "prompt", "lo", "hi"))).over(every)
    df = cells.withColumn("_best", first).withColumn("best", ok & (F.col("model") == F.col("_best.model")) & (F.col("prompt") == F.col("_best.prompt")))
    overlap = F.greatest("lo", "_best.lo") <= F.least("hi", "_best.hi")
    df = df.withColumn("tied", F.col("best") | F.coalesce(ok & overlap & F.col("_best.lo").isNotNull() & F.col("lo").isNotNull(), F.lit(False)))
    df = df.withColumn("_ties", F.count_if("tied").over(every)).withColumn("_cost", F.min(F.when(F.col("tied"), F.col("cost_score"))).over(every))
    df = df.withColumn("cost_tied", F.coalesce(F.col("tied") & (F.col("cost_score") <= F.col("_cost") * (1 + near)), F.lit(False))).withColumn("_costs", F.count_if("cost_tied").over(every))
    rationale = F.when(F.col("_best").isNull(), "all_dq_fail_pause").when(F.col("_ties") == 1, "ci_unique_argmin").when(F.col("_costs") == 1, "ci_overlap_cost_break").otherwise("fallback_named")
    named = (F.col("model") == fallback[0]) & (F.col("prompt") == fallback[1])
    df = df.withColumn("rationale", rationale)
    chosen = F.when(F.col("rationale") == "all_dq_fail_pause", False).when(F.col("rationale") == "ci_unique_argmin", F.col("best")).when(F.col("rationale") == "ci_overlap_cost_break", F.col("cost_tied")).otherwise(named)
    return df.withColumn("chosen", chosen).drop("_best", "_ties", "_cost", "_costs")


def select_cell(df: DataFrame, human: DataFrame, costs: dict[str, float], fallback: tuple[str, str], most_failures: float = 0.10, B: int = 1000) -> DataFrame:
    """The whole rule: every cell's failure rate, variance gate, error (failures as the largest error, and dropped), percentile interval with
    respondents resampled, cost score and outcome; the Random column is reported beside them and never eligible."""
    base = cells(df, human, most_failures).drop("rank", "chosen")
    means = df.groupBy("rid", "model", "prompt").agg(F.avg("err").alias("m")).where("m is not null").withColumn("one", F.lit(1.0))
    ci = ST.ratio_intervals(means, ["model", "prompt"], "m", "one", B=B, method="percentile").select("model", "prompt", "lo", "hi")
    loose = T.respondent_macro(df, ["model", "prompt"], "err_opt").select("model", "prompt", F.col("macro").alias("macro_optimistic"))
    price = F.element_at(F.create_map(*[F.lit(x) for pair in costs.items() for x in pair]), F.col("model"))
    rows = base.join(ci, ["model", "prompt"], "left").join(loose, ["model", "prompt"], "left").withColumn("cost_score", S.cost_score(price, F.col("parse_fail")))
    real = apply_rule(rows, fallback)
    random = T.respondent_macro(T.random_column(df, sorted(costs)), ["model", "prompt"]).select("model", "prompt", "macro")
    return real.unionByName(random, allowMissingColumns=True).withColumn("chosen", F.coalesce("chosen", F.lit(False)))
