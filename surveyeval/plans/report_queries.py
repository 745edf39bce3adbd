"""Registered report queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts as C
from ..operators import report as R
from . import fixtures as FX
from .queries import _ABL, _MEANS, _PROFILE, _UNIT, A, P, TR, panel, pred, query

_SHARE = "k AS (SELECT item, true_code, count(*) AS n FROM truth GROUP BY item, true_code), md AS (SELECT item, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS share FROM k GROUP BY item)"


@query("ag_headline", f"""{_MEANS}, i AS (SELECT condition, avg(e) AS item_macro FROM (SELECT condition, item, avg(err) AS e FROM p GROUP BY condition, item) q GROUP BY condition), r AS (SELECT condition, avg(m) AS respondent_macro, count(*) AS n FROM m GROUP BY condition),
 dl AS (SELECT condition, round(avg(delta), 6) AS delta, count(*) AS n_pairs FROM pairs GROUP BY condition)
 SELECT i.condition, round(respondent_macro, 6) AS respondent_macro, n AS n_respondents, round(item_macro, 6) AS item_macro, round(pooled, 6) AS pooled, delta, coalesce(n_pairs, 0) AS n_pairs FROM i JOIN r ON r.condition = i.condition JOIN (SELECT condition, avg(err) AS pooled FROM p GROUP BY condition) q ON q.condition = i.condition LEFT JOIN dl ON dl.condition = i.condition""")
def _(spark, d):
    return R.headline(pred(spark, d))


@query("ag_cell_rollup", f"""{A}, {_SHARE}, pr AS ({_PROFILE.format('model, prompt')}), f AS (SELECT pr.*, share, CASE WHEN hi - lo + 1 >= 3 THEN top1_share > 0.95 ELSE distinct_codes = 1 END AS c FROM pr JOIN items ON items.item = pr.item JOIN md ON md.item = pr.item)
 SELECT model, prompt, round(avg(em), 6) AS em, round(avg(err), 6) AS err, round(avg(parse_rate), 6) AS parse_rate, count(*) FILTER (c) AS n_collapsed, coalesce(string_agg(item, ',' ORDER BY item) FILTER (c), '') AS collapsed_items, count(*) FILTER (em > share) AS n_positive_lift FROM f GROUP BY model, prompt""")
def _(spark, d):
    return R.cell_rollup(panel(spark, d), FX.truth(spark, d))


_SIDES = ", ".join(f"max(CASE WHEN model = '{m}' THEN {c} END) AS {c}_{s}" for m, s in (("cheap_a", "a"), ("cheap_d", "b")) for c in ("em", "err", "top1_share"))


@query("ag_dissection", f"{A}, pr AS ({_PROFILE.format('model')}) SELECT item, {_SIDES} FROM pr GROUP BY item")
def _(spark, d):
    return R.dissection(panel(spark, d), "cheap_a", "cheap_d")


@query("ag_item_flip", f"{A} SELECT item, hi - lo + 1 AS levels, round(avg(exact0), 6) AS exact, round(avg(err), 6) AS err FROM p GROUP BY item, lo, hi")
def _(spark, d):
    return R.item_flip(panel(spark, d))


@query("ag_anchor_compare", f"""{A}, {_SHARE} SELECT p.item, round(avg(exact0) FILTER (model <> 'cheap_d'), 6) AS em_panel, round(avg(exact0) FILTER (model = 'cheap_d'), 6) AS em_anchor, round(avg(err) FILTER (model <> 'cheap_d'), 6) AS err_panel, round(avg(err) FILTER (model = 'cheap_d'), 6) AS err_anchor, max(share) AS em_majority
 FROM p JOIN md ON md.item = p.item GROUP BY p.item""")
def _(spark, d):
    return R.anchor_compare(panel(spark, d), FX.truth(spark, d), "cheap_d")


@query("ag_r1_cost", f"{_ABL} SELECT item, round(avg(other - base), 6) AS delta, count(*) AS n_pairs FROM ab GROUP BY item")
def _(spark, d):
    return R.rule_cost(pred(spark, d))


@query("ag_coverage", f"{TR} SELECT item, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / (SELECT count(*) FROM customer), 6) AS percent FROM truth GROUP BY item")
def _(spark, d):
    return R.coverage(FX.truth(spark, d), spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"))


@query("sel_single_model", f"""{A}, parts AS (SELECT c_custkey AS rid, CASE WHEN {_UNIT.format('c_custkey')} < {2**31} THEN 'train' ELSE 'test' END AS part FROM customer),
 q AS (SELECT model, part, rid, avg(CAST(abs_err AS DOUBLE)) AS m FROM p JOIN parts USING (rid) WHERE parse_ok AND fmt LIKE 'likert%' GROUP BY model, part, rid),
 z AS (SELECT model, round(avg(m) FILTER (part = 'train'), 6) AS train, round(avg(m) FILTER (part = 'test'), 6) AS validation, CASE model WHEN 'cheap_a' THEN 0.0001 WHEN 'cheap_b' THEN 0.0002 WHEN 'cheap_c' THEN 0.0004 ELSE 0 END AS rate FROM q GROUP BY model)
 SELECT model, train, validation FROM z WHERE train <= (SELECT min(train) FROM z) * CAST(1.05 AS DOUBLE) ORDER BY rate, train, model LIMIT 1""")
def _(spark, d):
    rates = spark.createDataFrame([("cheap_a", 0.0001), ("cheap_b", 0.0002), ("cheap_c", 0.0004)], "model string, rate double")
    parts = C.split(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("rid")), 0.5)
    return R.single_model(panel(spark, d), parts, rates)
