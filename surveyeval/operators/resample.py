"""Bootstraps of composed statistics: one pass makes paired replicates of wide sums, closed forms follow on B rows."""

from __future__ import annotations

from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import stats as ST
from . import tables as T


def replicates(clusters: DataFrame, cols: list[str], cluster: str = "rid", B: int = 1000, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(sums of all clusters, B x len(cols) replicate sums); what reaches the driver is bounded by B and the columns."""
    total = clusters.agg(*[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in cols]).first()
    draws = ST.poisson_boot(clusters, cluster, cols, B, seed).orderBy("replicate").toPandas()[cols].to_numpy(float)
    return np.array([total[c] or 0.0 for c in cols]), draws


def _ratio(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.divide(s, n, out=np.full(np.shape(s), np.nan), where=np.asarray(n) > 0)


def _interval(draws: np.ndarray) -> tuple[float, float]:
    kept = draws[np.isfinite(draws)]
    if not len(kept):
        return float("nan"), float("nan")
    return tuple(float(v) for v in np.quantile(kept, [0.025, 0.975]))


def cell_replicates(df: DataFrame, groups: list[tuple], by: list[str], values: list[str], cluster: str = "rid", B: int = 1000, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """`replicates` of the columns (values.., rows) of every group, group by group: (sums, B x sums) for the groups listed, of the columns `by`.

    A cluster's cells need no wide row: they have one weight wherever they stand, and a batch of them becomes a matrix inside the task.  The sums themselves
    come from the same pass, as replicate -1.
    """
    cells = df.groupBy(cluster, *by).agg(*[F.sum(v).cast("double").alias(f"_s{i}") for i, v in enumerate(values)], F.count("*").cast("double").alias(f"_s{len(values)}"))
    width, place = len(values) + 1, {g: i for i, g in enumerate(groups)}
    sums = [f"_s{i}" for i in range(width)]
    cells = cells.select(F.xxhash64(cluster).alias("_k"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in sums])

    def draw(batches):
        out = np.zeros((B + 1, len(groups) * width))
        for pdf in batches:
            at = np.array([place.get(g, -1) for g in zip(*[pdf[f"_g{i}"] for i in range(len(by))], strict=True)], np.int64)
            keys, who = np.unique(pdf["_k"].to_numpy(np.int64), return_inverse=True)
            x, known = pdf[sums].to_numpy(float), at >= 0
            for first in range(0, len(keys), 1000):
                rows = np.flatnonzero(known & (who >= first) & (who < first + 1000))
                part = np.zeros((min(1000, len(keys) - first), len(groups), width))
                np.add.at(part, (who[rows] - first, at[rows]), x[rows])
                part = part.reshape(len(part), -1)
                out[0] += part.sum(0)
                out[1:] += ST.poisson_weights(keys[first : first + 1000], B, seed) @ part
        yield pd.DataFrame(out, columns=names).assign(replicate=np.arange(-1, B))[["replicate", *names]]

    names = [f"c{i}" for i in range(len(groups) * width)]
    drawn = cells.mapInPandas(draw, "replicate long, " + ", ".join(f"{c} double" for c in names)).groupBy("replicate").agg(*[F.sum(c).alias(c) for c in names])
    table = drawn.toPandas().sort_values("replicate")[names].to_numpy(float)  # B + 1 rows
    if not len(table):
        table = np.zeros((B + 1, len(names)))
    return table[0], table[1:]


def item_macro(df: DataFrame, by: list[str], items: list[str], column: str = "model", cluster: str = "rid", B: int = 1000) -> list[dict]:
    """Mean of item means of error and exact match for each level of `column`, with percentile intervals; all levels share the resamples."""
    total, draws = cell_replicates(df, [(m, i) for m in by for i in items], [column, "item"], ["err", "exact0"], cluster, B)
    shape = (len(by), len(items), 3)
    t, d = total.reshape(shape), draws.reshape(len(draws), *shape)
    out = []
    for at, level in enumerate(by):
        row = {column: level}
        for k, v in enumerate(("err", "exact")):
            means = _ratio(t[at, :, k], t[at, :, 2])
            with np.errstate(all="ignore"):
                each = _ratio(d[:, at, :, k], d[:, at, :, 2])
                boot = np.where(np.isfinite(each).any(1), np.nansum(each, 1) / np.maximum(1, np.isfinite(each).sum(1)), np.nan)
            lo, hi = _interval(boot)
            row |= {v: float(np.nanmean(means)) if np.isfinite(means).any() else None, f"{v}_lo": lo, f"{v}_hi": hi}
        out.append(row)
    return out


def shapley_matrix(players: int = 4) -> np.ndarray:
    """(players, 2^players) weights that turn subset errors into Shapley values of error removed."""
    m = np.zeros((players, 2**players))
    for mask in range(2**players):
        for p in range(players):
            if not mask >> p & 1:
                s = mask.bit_count()
                w = factorial(s) * factorial(players - s - 1) / factorial(players)
                m[p, mask] += w
                m[p, mask | 1 << p] -= w
    return m


def shapley_intervals(df: DataFrame, mask: str = "mask", value: str = "err", players: int = 4, cluster: str = "rid", B: int = 1000) -> list[dict]:
    """Shapley value of each player and the interaction share, with paired percentile intervals (one resample for all subsets)."""
    n = 2**players
    total, draws = cell_replicates(df, [(m,) for m in range(n)], [mask], [value], cluster, B)
    point = _ratio(total.reshape(n, 2)[:, 0], total.reshape(n, 2)[:, 1])
    boot = _ratio(draws.reshape(-1, n, 2)[:, :, 0], draws.reshape(-1, n, 2)[:, :, 1])
    if not np.isfinite(point).all():
        raise ValueError("every subset needs at least one row")
    weights = shapley_matrix(players)
    sign = np.array([[1 if (t & s).bit_count() % 2 == 0 else -1 for s in range(n)] for t in range(n)]) / n
    order = np.array([t.bit_count() for t in range(n)])

    def share(v: np.ndarray) -> np.ndarray:
        a2 = (v @ sign.T) ** 2
        every = a2[..., order >= 1].sum(-1)
        return np.where(every > 0, a2[..., order >= 2].sum(-1) / np.where(every > 0, every, 1), 0.0)

    out = []
    for p in range(players):
        lo, hi = _interval(boot @ weights[p])
        out.append({"term": f"player_{p}", "value": float(weights[p] @ point), "lo": lo, "hi": hi})
    lo, hi = _interval(share(boot))
    return [*out, {"term": "interaction_share", "value": float(share(point)), "lo": lo, "hi": hi}]


def router_intervals(df: DataFrame, parts: DataFrame, value: str = "err", B: int = 3000) -> list[dict]:
    """Error of the routed and the best single model on test respondents, and their gap, with percentile intervals; choices come from train alone."""
    rows = df.join(parts.hint("shuffle_hash"), "rid")  # one row for each respondent
    train = rows.where("part = 'train'").groupBy("item", "model").agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    best = train.groupBy("item").agg(F.min_by("model", F.struct(F.col("s") / F.col("n"), "model")).alias("routed"))
    single = train.groupBy("model").agg((F.sum("s") / F.sum("n")).alias("m")).agg(F.min_by("model", F.struct("m", "model")).alias("single"))
    test = rows.where("part = 'test'").join(F.broadcast(best), "item").join(F.broadcast(single))  # one row per item, and one row
    wide = test.groupBy("rid").agg(*[x for c in ("routed", "single") for x in (F.sum(F.when(F.col("model") == F.col(c), F.col(value))).alias(f"{c}_s"), F.count(F.when(F.col("model") == F.col(c), F.col(value))).alias(f"{c}_n"))])
    t, d = replicates(wide, ["routed_s", "routed_n", "single_s", "single_n"], B=B)
    stat = lambda x: {"routed": _ratio(x[..., 0], x[..., 1]), "single": _ratio(x[..., 2], x[..., 3])}
    point, boot = stat(t), stat(d)
    out = []
    for name, p, b in (("routed", point["routed"], boot["routed"]), ("single", point["single"], boot["single"]), ("gap", point["single"] - point["routed"], boot["single"] - boot["routed"])):
        lo, hi = _interval(b)
        out.append({"statistic": name, "value": float(p), "lo": lo, "hi": hi})
    return out


def battery_drops(df: DataFrame, batteries: DataFrame, B: int = 1000, least: int = 30) -> DataFrame:
    """Every battery's paired error delta with interval, p (at least 1/B; 1 below `least` pairs), Holm inside its bin and over all, label and rank.

    A battery of the map without any pair is an error.
    """
    names = [(r["battery_no"], r["battery"], r["bin"]) for r in batteries.orderBy("battery_no").collect()]
    pairs = T.pair_ablation(df).withColumn("delta", F.col("other") - F.col("base"))
    t, d = cell_replicates(pairs, [(n,) for n, _, _ in names], ["battery_no"], ["delta"], B=B)
    rows = []
    for i, (_, battery, bin_) in enumerate(names):
        s, n = t[2 * i], t[2 * i + 1]
        if not n:
            raise ValueError(f"no pairs for {battery}")
        boot = _ratio(d[:, 2 * i], d[:, 2 * i + 1])
        boot = boot[np.isfinite(boot)]
        lo, hi, p = float("nan"), float("nan"), 1.0
        if n >= least:
            lo, hi = _interval(boot)
            p = min(1.0, max(2 * min((boot <= 0).mean(), (boot >= 0).mean()), 1 / B))
        rows.append((battery, bin_, float(s / n), int(n), lo, hi, float(p)))
    table = df.sparkSession.createDataFrame(rows, "battery string, bin string, delta double, n_pairs long, lo double, hi double, p double")
    nested = T.holm(table, ["bin"], key="battery").withColumnsRenamed({"p_adj": "p_bin", "significant": "significant_bin"})
    joint = T.holm(nested.withColumn("_all", F.lit(0)), ["_all"], key="battery").drop("_all").withColumnsRenamed({"p_adj": "p_all", "significant": "significant_all"})
    joint = joint.withColumn("effect", S.effect_label(F.col("delta"))).withColumn("substantive", S.substantive_flag(F.col("significant_bin"), F.col("effect"), F.col("lo")))
    return joint.withColumn("rank", F.row_number().over(Window.partitionBy("bin").orderBy(F.desc("delta"), "battery")).cast("long"))
